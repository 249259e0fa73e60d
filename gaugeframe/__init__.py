"""gaugeframe: evaluation analytics expressed as Spark DataFrame plans."""
