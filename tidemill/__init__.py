"""Data quality and data preparation as Spark plans."""
