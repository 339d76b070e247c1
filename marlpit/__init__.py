"""marlpit: document and table analytics on PySpark."""
