"""Parcelon: plans."""
