"""tessera: criteria queries over records, XML node tables and rows, as Spark DataFrame operations."""
