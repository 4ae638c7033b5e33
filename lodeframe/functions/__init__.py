"""Scalar and aggregate functions as Columns, with their typing."""
