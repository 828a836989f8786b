"""Readers and writers: raw files, versioned tables, file layout, data dictionary."""
