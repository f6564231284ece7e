"""Text-corpus analytics on PySpark."""
