"""barflow: market, event and text analytics as Spark DataFrame operators."""
