"""Analytics on PySpark: retrieval, time series, trading signals, grid graphs, lookups and evaluation."""
