"""millrace: an analytics engine on the PySpark DataFrame and SQL API."""
