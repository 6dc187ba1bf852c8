"""DataFrame -> DataFrame operators. Column names are parameters so the
daily (track R) and weekly (track A) panels share one code path."""
