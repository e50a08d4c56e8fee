"""Market-signal research on Spark: bars in, scored, backtested and evaluated signals out."""
