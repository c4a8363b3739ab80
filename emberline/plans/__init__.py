"""Whole plans: the plant facade and the registered queries."""
