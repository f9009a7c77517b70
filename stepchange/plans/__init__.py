"""Whole plans: the study on a set of tables, and the registered queries."""
