"""Text-and-web analytics as PySpark DataFrame operators."""
