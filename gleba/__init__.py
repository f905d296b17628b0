"""gleba: listing-data operators for PySpark."""
