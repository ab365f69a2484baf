"""Column-level functions (JVM-side expressions; one Arrow UDF for HTML entities)."""
