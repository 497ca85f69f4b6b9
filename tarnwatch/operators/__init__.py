"""Detectors as aggregates, windows, ordered folds and model tables."""
