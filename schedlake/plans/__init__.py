"""Registered queries: operators applied to the stored tables."""
