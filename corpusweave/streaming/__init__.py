"""Structured Streaming forms of the operators, each with a batch twin."""
