"""Ohmweave: linear dynamical systems, circuits and sparse graphs as Spark DataFrames."""
