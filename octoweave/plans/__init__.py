"""Predictors, the entropy coder and the codec plans built on them."""
