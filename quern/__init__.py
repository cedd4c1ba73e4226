"""quern: retrieval, chunking and corpus-preparation operators for PySpark."""
