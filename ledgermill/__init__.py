"""Batch analytics over company registers, filings, electronic accounts and page text, as Spark DataFrame jobs."""
