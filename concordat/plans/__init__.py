"""Whole queries: the bridge view, the query list and its oracle SQL."""
