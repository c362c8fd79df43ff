"""tapeloom: tick data to labelled datasets with Spark DataFrames."""
