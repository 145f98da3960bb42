"""Table schemas, readers, writers and sessions."""
