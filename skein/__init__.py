"""skein: retrieval, graph and text analytics expressed as Spark DataFrame plans."""
