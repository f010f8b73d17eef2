"""Parcelon: functions."""
