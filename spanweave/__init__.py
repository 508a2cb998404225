"""Rule-driven span analytics on PySpark."""
