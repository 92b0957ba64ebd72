"""Operators for preparing training text. Nothing else in planlake imports this package."""
