"""Composed plans: the feature pipeline, models and batch jobs."""
