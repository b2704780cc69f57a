"""Operators: validation, sampling, column stages, selection, model, tuning."""
