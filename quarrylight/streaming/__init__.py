"""Structured Streaming jobs over flow and event feeds."""
