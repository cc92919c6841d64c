"""Fine-tuning data preparation and evaluation as composable Spark DataFrame transformations."""
