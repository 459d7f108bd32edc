"""Readers and writers of sequence, structure and result files."""
