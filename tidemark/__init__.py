"""Timeline analytics on Spark: labelled, scored event logs in, ranked intervals out."""
