"""Temporal-logic analytics over labelled time series, and corpus operators, on Spark."""
