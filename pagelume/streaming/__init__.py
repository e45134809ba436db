"""Incremental forms of the censuses."""
