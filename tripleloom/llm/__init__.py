"""Operators for preparing training text: each module is one operator.

Nothing outside this subpackage imports it.
"""
