"""Spark-native content scoring, crawl analytics and corpus preparation."""
