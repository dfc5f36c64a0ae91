"""Labelled-corpus curation and classifier evaluation as Spark DataFrame operators."""
