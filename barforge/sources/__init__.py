"""Readers and writers: lake, archives, configuration, journal, results store."""
