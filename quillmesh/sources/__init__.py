"""Sources and sinks. Everything is read and written through Spark, so paths may be in any store that it knows."""
