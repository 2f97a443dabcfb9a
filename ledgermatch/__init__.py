"""Dataset reconciliation and metadata derivation on Spark DataFrames."""
