"""Model operators on pyspark.ml."""
