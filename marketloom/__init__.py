"""Market-signal analytics and corpus preparation on PySpark DataFrames."""
