"""Operators on training text and learned matching.

Nothing outside this package imports it; it may be deleted as a whole.
"""
