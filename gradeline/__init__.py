"""Label extraction, scoring and run analytics for model output, on Spark DataFrames."""
