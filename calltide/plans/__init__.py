"""Ready queries over the trace tables, with SQL equivalents."""
