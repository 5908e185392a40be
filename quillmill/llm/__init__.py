"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it. Each module holds one operator with a
general DataFrame interface; ``queries`` binds them to the tables of the checks.
"""
