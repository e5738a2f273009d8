"""Structured Streaming forms of the rules that are stateful by meaning."""
