"""Entity resolution and signal analytics over public records, as Spark DataFrame plans."""
