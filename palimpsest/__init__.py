"""Palimpsest: a Spark-native engine for versioned document memory and hybrid retrieval."""
