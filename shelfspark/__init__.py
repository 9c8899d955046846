"""Spark-native analytics for product catalogs: feeds, matching, alternatives, page quality."""
