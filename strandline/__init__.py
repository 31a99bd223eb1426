"""strandline: DataFrame operators for text, timed segments, signals and event streams."""
