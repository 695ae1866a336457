"""Rubric scoring, rater agreement and corpus preparation as Spark jobs."""
