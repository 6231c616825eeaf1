"""tracewell: a Spark-first engine for agent session data and text corpora."""
