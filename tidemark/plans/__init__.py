"""Registered queries with their SQL for comparison."""
