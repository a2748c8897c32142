"""Scalar functions of code and document search, as Catalyst expressions or query-side helpers."""
