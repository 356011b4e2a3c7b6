"""Column expressions (survey §2.B). All JVM-side; no Python UDFs."""
