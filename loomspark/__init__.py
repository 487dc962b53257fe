"""loomspark: tabular analytics and text retrieval expressed as Spark DataFrame plans."""
