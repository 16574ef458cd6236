"""Registered queries over the supplied tables, with their SQL counterparts."""
