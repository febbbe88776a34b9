"""Operators for preparing training text. Nothing else in the library imports this package.

Every operator takes DataFrames, leaves columns that it doesn't know alone, and says in its docstring
what null, empty, repeated and very long texts give.
"""
