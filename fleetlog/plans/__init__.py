"""Composite plans: reports, payloads and the registered fixture queries."""
