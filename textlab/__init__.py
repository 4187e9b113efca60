"""textlab: Spark-native text labelling, sampling and classifier evaluation."""
