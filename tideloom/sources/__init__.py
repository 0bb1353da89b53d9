"""Relations, readers and writers."""
