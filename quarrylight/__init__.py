"""Quarrylight: evidence, code and document corpus analytics as Spark jobs."""
