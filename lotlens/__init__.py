"""lotlens: listing-market analytics as composable Spark DataFrame operators."""
