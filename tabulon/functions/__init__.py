"""Scalar functions: Column to Column, built from Spark's own expressions."""
