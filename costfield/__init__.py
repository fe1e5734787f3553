"""Gridded cost modelling and least-cost networks as Spark DataFrame jobs."""
