"""Execution plans shared by operators: ordered folds, and the registered queries."""
