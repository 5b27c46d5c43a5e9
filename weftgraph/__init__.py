"""weftgraph: structural analysis of named-entity graphs on PySpark DataFrames."""
