"""Evidence-retrieval analytics on Spark: every operator is a DataFrame-to-DataFrame plan."""
