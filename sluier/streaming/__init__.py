"""Micro-batch form of the main plan."""
