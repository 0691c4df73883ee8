"""cairnlake: knowledge-base analytics as Spark DataFrame plans."""
