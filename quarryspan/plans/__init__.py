"""Registered queries, each beside its SQL counterpart."""
