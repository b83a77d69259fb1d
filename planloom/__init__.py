"""Text-run quality operators for drawing corpora, as Spark DataFrames."""
