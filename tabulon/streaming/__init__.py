"""Logs that still grow: the same folds over a stream."""
