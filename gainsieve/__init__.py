"""Feature ranking, selection and model evaluation on Spark DataFrames."""
