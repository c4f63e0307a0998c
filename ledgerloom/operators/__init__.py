"""Operators over records, terms, reviews and ledgers, as functions from DataFrame to DataFrame."""
