"""veridex: evidence analytics as composable Spark DataFrame operators."""
