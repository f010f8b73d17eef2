"""Parcelon: a PySpark-native engine for keyed polygon datasets."""
