"""Event-history cohort analytics as ordinary Spark jobs."""
