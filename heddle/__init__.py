"""heddle: a Spark-native engine for records of business entities, and the operators of a training-data pipeline."""
