"""Readers, writers and the testdata views."""
