"""Readers, writers and the mapping from the test tables to the complaint model."""
