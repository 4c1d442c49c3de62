"""Zone-risk analytics on Spark: rates, scans, entity resolution, forecasts and alerts as DataFrame operations."""
