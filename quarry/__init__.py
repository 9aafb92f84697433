"""quarry: a Spark-first engine for catalogues of recovered files and raw byte sources."""
