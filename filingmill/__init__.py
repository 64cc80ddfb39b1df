"""Equity-filings analytics on Spark."""
