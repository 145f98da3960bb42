"""Whole workflows: the ensemble estimator and its model."""
