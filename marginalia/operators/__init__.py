"""Relational operators: DataFrame(s) in, DataFrame out, no actions unless a docstring says so."""
