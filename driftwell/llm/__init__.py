"""Operators for preparing training data and summarising huge event logs."""
