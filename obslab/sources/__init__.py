"""Readers and writers: tables, observation logs, file fingerprints, versions."""
