"""foretide: leakage-safe temporal feature engineering on Spark DataFrames."""
