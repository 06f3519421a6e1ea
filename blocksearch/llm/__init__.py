"""Operators for preparing training text. Nothing else in the library imports
this subpackage; it can be removed as a whole."""
