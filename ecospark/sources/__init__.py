"""Scans and sinks (SURVEY A*): CSV, line lists, SDF records, payload columns, split writers."""
