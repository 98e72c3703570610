"""Readers and writers of the formats the corpus jobs use."""
