"""Spark-native record processing: decode, normalise, validate, resolve, score, map and audit identity records."""
