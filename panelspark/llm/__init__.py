"""Operators for preparing training text, each in a module of its own.

Nothing in the rest of the library imports this subpackage. ``queries`` holds the
registered queries and their SQL.
"""
