"""Expressions that operators are built of, and the fixed values they use."""
