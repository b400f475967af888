"""Registered queries over the driver tables, each beside its reference SQL."""
