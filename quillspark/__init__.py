"""quillspark: a Spark-native corpus analytics engine."""
