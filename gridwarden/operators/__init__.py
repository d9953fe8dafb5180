"""Relational operators on findings, code lines and scan history.

Each takes a dialect and the names of its inputs and returns SQL. functions.run.apply() runs one on DataFrames.
Findings have the columns of sources.fixtures.issues(); `cases` are findings with the code they are in.
Rows of one document are told apart and ordered by seq.
"""
