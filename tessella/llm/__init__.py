"""Operators for preparing training corpora, each in a module of its own."""
