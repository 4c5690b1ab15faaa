"""Search-opportunity analytics as composable Spark DataFrame transforms."""
