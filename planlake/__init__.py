"""planlake: Spark jobs for planning-notes analytics."""
