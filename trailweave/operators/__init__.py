"""Trailweave operators."""
