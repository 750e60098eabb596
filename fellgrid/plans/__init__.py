"""Plans: operators put together into the metrics and queries that users run."""
