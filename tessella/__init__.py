"""Web-content and tabular analytics on PySpark."""
