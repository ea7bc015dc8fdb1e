"""textward: screening of large text tables for prompt injection and leaks, on Spark."""
