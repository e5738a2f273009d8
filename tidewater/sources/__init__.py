"""Inputs: bindings of the given tables and parsers of landed feeds."""
