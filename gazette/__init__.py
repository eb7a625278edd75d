"""Announcement analytics on Spark: DataFrame transforms and Column functions for public-notice data."""
