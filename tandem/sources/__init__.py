"""Readers and writers for sheets, records, matches, evaluation sets and exports."""
