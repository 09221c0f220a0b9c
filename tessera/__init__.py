"""Spark-native harmonization of heterogeneous tables at the metadata level."""
