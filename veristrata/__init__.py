"""Veristrata: a PySpark-native engine for evidence ledgers, document search and citation graphs."""
