"""Gap-free event-count panels, one-step-ahead forecasts and their reports, as Spark DataFrame operations."""
