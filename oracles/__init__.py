"""Independent SQL for every registered query that SQL can express."""
