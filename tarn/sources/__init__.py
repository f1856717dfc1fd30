"""Sources and sinks beyond Spark's own: paged files and delimited text."""
