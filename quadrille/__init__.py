"""Quadrille: spatial point analytics on PySpark DataFrames."""
