"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it; the entry module adds its queries only when it can be imported.
"""
