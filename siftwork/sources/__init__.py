"""Table schemas, readers, writers and the stand-in tables of the test data."""
