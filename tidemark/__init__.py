"""A point-in-time analytics engine expressed as Spark plans."""
