"""Parcelon: operators."""
