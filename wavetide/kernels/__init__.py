"""Numpy kernels without any Spark import."""
