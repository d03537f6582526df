"""Event-panel analytics as composable Spark DataFrame operators."""
