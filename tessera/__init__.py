"""tessera: a web index and fact reconciliation engine expressed as Spark DataFrames."""
