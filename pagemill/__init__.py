"""Web pages, documents and usage logs as analysable tables, on PySpark."""
