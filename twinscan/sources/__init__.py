"""Scans, decoders and the fingerprint cache."""
