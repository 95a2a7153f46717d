"""Continuous scans: files that arrive are matched against the cached hashes."""
