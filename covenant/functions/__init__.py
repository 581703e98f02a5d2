"""Scalar and aggregate functions as Column builders."""
