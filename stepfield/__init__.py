"""stepfield: trajectory analytics as composable PySpark DataFrame operators."""
