"""A Spark-native engine for turning recognised text into safe, compact, accountable text."""
