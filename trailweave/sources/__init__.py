"""Trailweave sources."""
