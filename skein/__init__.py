"""skein: retrieval, ranking and knowledge-graph analytics as Spark plans."""
