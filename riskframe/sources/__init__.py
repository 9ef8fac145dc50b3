"""Sources and sinks: test tables and bindings, report table, files."""
