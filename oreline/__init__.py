"""oreline: repository-evidence analytics and training-data operators on PySpark DataFrames."""
