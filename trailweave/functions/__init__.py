"""Trailweave functions."""
