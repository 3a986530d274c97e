"""Operators over DataFrames: scans, correlations, resolution, baselines, evaluation."""
