"""tahlil: Spark-native masking, checking and analysis of collections of documents."""
