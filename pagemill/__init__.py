"""pagemill: HTML-to-Markdown and corpus preparation on Spark DataFrames."""
