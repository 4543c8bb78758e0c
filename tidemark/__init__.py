"""Tidemark: quantitative research analytics written as Spark jobs."""
