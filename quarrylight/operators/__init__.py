"""DataFrame -> DataFrame operators over chunks, vectors, flows, events and run records."""
