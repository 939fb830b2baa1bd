"""Sources and sinks: directories of files, report files, grammars, parse tables, statistics."""
