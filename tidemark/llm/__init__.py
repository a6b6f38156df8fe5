"""Operators for training-data pipelines.  Self-contained: the rest of the library never imports it."""
