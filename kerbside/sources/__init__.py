"""Readers and writers: everything that touches storage."""
