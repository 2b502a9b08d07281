"""Readers that give DataFrames: source trees, captures, event feeds, packages and manifests."""
