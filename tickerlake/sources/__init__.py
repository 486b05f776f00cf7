"""Readers and writers for exchange files, statements and the raw zone."""
