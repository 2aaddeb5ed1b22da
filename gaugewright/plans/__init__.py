"""Registered queries and multi-step pipelines."""
