"""edgeloom: a Spark-native engine for exploring one table of typed, labelled edges."""
