"""Operators for preparing training text at scale.

Each module holds one operator; ``queries`` registers them.  Nothing outside this
subpackage imports it.
"""
