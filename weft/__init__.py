"""weft: property-graph traversals compiled to Spark DataFrames."""
