"""Tessera: a PySpark-native engine for Korean morphology and corpus analytics."""
