"""Joins, grouping and curation of near duplicates as DataFrame builders."""
