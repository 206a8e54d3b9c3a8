"""Product matching and corpus preparation as composable Spark DataFrame transforms."""
