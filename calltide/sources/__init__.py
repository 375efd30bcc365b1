"""Readers and writers of trace formats."""
