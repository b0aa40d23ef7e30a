"""pulsegrid: DataFrame-in, DataFrame-out analytics for event and sampled-signal data on Spark."""
