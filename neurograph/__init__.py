"""Graph, time-series and omics analytics as Spark DataFrame plans."""
