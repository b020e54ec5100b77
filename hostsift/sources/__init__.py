"""Feed readers and table writers."""
