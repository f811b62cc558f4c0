"""Readers and writers: raw items, cursors, tables, upserts, files."""
