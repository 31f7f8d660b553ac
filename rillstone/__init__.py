"""Stream and table analytics on PySpark."""
