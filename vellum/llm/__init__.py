"""Operators for preparing large text and record corpora.

Nothing outside this subpackage imports it; ``queries`` holds what the entry module registers.
"""
