"""fathomgrid: relational, text, vector and graph operators over Spark DataFrames."""
