"""A Spark-native catalog engine for location and media histories, with operators for training-data pipelines."""
