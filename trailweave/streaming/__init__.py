"""Trailweave streaming."""
