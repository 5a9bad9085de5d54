"""Operators for preparing training data; see the README's section on this subpackage."""
