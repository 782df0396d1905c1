"""Typed statements as DataFrame plans."""
