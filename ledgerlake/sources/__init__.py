"""Readers and writers: bindings of tables, log files, NDJSON, directory listings."""
