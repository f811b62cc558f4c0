"""Relational operators of the brief: filters with reasons, dedup, quotas, events, reports."""
