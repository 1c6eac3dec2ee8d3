"""corpuskiln: Spark-first corpus packing, experiment planning and report queries."""
