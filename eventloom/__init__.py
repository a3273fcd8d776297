"""Event and conversation history analytics on Spark DataFrames."""
