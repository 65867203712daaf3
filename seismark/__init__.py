"""Seismark: analytics over disaster news, labels and prices, built on Spark DataFrames."""
