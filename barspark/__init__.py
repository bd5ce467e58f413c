"""Spark jobs for market data, signals, back-tests and journals."""
