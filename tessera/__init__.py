"""Spark-native retrieval, ingest and CRM analytics operators."""
