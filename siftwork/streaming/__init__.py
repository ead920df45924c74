"""The same rules over streams of requests."""
