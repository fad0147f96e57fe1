"""Column-to-column functions; everything here stays inside generated JVM code unless noted."""
