"""Entity linking over annotated text, expressed as Spark DataFrame plans."""
