"""Feedloom: PySpark jobs for a market-news and social intelligence feed."""
