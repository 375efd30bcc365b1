"""Operators for training data made from traces and their texts. Nothing outside this folder imports it."""
