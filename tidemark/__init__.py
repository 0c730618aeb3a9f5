"""Session-aligned text-signal analytics on PySpark."""
