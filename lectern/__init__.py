"""Evidence-library, retrieval and tournament analytics as Spark DataFrame operators."""
