"""reposieve: audit source-code repositories as Spark DataFrames."""
