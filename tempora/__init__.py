"""tempora: dated, posed media analytics as PySpark DataFrame programs."""
