"""Operators over tables of documents, spans, decisions, mappings and audit rows."""
