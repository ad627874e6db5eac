"""factloom: software-knowledge analytics as plain functions from DataFrames to DataFrames."""
