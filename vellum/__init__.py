"""Vellum: bibliographic and document record processing on Spark DataFrames."""
