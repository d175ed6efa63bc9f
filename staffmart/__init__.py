"""staffmart: people-data cleaning, star-schema loading and analytics as Spark jobs."""
