"""A Spark-native location analytics engine."""
