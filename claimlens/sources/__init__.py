"""Table views, readers and writers."""
