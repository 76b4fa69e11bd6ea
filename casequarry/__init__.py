"""Case-retrieval and rule-inference analytics expressed as Spark DataFrame plans."""
