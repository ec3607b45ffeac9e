"""Uncertainty-aware decision support on Spark."""
