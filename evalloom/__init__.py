"""evalloom: evaluation analytics for multi-step language-model pipelines, on Spark DataFrames."""
