"""paperloom: tables out of paged documents, as Spark DataFrames."""
