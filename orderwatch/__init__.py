"""Marketplace fulfilment-risk analytics as Spark DataFrame jobs."""
