"""quillmill: preparing, indexing and querying document collections on Apache Spark."""
