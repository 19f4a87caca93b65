"""Cleaning as documents arrive."""
