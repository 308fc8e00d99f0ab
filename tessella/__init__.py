"""Catalogue enrichment and analytics engine expressed with Spark DataFrames."""
