"""Column functions; all run on the JVM."""
