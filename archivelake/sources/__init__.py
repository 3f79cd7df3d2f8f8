"""Containers, codecs, storage and the Spark data source."""
