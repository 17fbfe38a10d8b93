"""spanloom: span-level text analytics as PySpark DataFrame plans."""
