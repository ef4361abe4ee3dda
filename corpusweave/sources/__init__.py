"""Corpora, bindings and sinks."""
