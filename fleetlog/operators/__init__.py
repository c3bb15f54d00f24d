"""Row-level and keyed operators."""
