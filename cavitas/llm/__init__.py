"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it. Each module holds one operator;
``queries`` registers them.
"""
