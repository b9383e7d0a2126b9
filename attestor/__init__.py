"""attestor: a Spark-first engine for media-authenticity and corpus-quality analytics."""
