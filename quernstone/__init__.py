"""quernstone: text, association and ranking analytics as composable Spark DataFrame operators."""
