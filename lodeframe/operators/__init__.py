"""Operators that other modules compose."""
