"""Field search and corpus preparation expressed as Spark DataFrame and SQL plans."""
