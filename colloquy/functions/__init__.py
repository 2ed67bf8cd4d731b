"""Column helpers built from JVM-side Spark functions."""
