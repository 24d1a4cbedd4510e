"""Scalar functions (text and numeric arrays) as Spark Column expressions."""
