"""Typed table access, relations, mutations and schema changes as Spark DataFrame plans."""
