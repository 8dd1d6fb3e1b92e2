"""tilewright: spatial-omics analytics as Spark DataFrame operators."""
