"""Operators over page tables."""
