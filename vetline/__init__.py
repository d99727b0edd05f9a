"""Document-screening analytics on Spark: DataFrame operators for tables and streams of travel documents."""
