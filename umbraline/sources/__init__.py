"""Readers and writers: typed tables in, rejected rows kept apart."""
