"""Predicates and label functions."""
