"""Relational operators: frames with an explicit order, grouping, positional windows, reshaping."""
