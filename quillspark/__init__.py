"""Spark-native text triage, claim cross-reference and page cleaning."""
