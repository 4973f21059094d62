"""Registered queries and their SQL counterparts over the test tables."""
