"""Spark-first analytics for paired-year assessments, curriculum catalogues and ordered extracts."""
