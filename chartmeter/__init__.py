"""Chart data from tables, chart records from figure JSON, and scores for them, on Spark."""
