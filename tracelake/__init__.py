"""tracelake: analytics over application I/O traces, expressed as Spark DataFrame plans."""
