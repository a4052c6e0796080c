"""quillstone: append-only temporal assertions and their queries as Spark DataFrame plans."""
