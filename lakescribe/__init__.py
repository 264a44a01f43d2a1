"""lakescribe: Spark-first operators for building and analysing multi-source text collections."""
