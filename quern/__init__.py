"""quern: assessment-log analytics and training-data operators on PySpark DataFrames."""
