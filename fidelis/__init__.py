"""Fidelis: privacy and fidelity analytics for network traffic on Spark DataFrames."""
