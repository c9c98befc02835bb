"""Operators on bars: quality, segments, resampling, alignment, features, kernels."""
