"""Column functions: they take and return `Column` and stay inside the JVM."""
