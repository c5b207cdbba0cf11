"""Column expressions (JVM-side built-ins and higher-order functions; no Python per row)."""
