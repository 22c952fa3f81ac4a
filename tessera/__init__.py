"""Tessera: a PySpark-native analytics engine for image catalogs, tile pyramids and text corpora."""
