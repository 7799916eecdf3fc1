"""Operators for preparing training text. Nothing else in silkmoth imports this."""
