"""corvane: a PySpark-native engine for auditing and evaluating text-to-SQL corpora."""
