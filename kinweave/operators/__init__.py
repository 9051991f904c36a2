"""Blocking, features, windows, decisions, rules, models and assembly: DataFrame to DataFrame."""
