"""Relational operators over page records: DataFrame in, DataFrame out."""
