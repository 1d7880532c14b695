"""Leafmill: document-layout analysis and corpus preparation as Spark DataFrames."""
