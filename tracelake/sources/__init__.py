"""Sources and sinks: trace text, archives, Parquet blocks, output files."""
