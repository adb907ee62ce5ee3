"""lorekeep: temporal-graph and hybrid-retrieval analytics on PySpark."""
