"""Listing, price and review integrity analytics on Spark DataFrames."""
