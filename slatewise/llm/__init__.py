"""Operators of a large-scale training-data pipeline.

Each module holds one operator with a general interface; ``queries`` binds
them to the driver tables. Nothing outside this package imports it.
"""
