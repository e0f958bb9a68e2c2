"""Evidence retrieval, structuring and evaluation as Spark DataFrame operators."""
