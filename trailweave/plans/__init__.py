"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their oracle SQL."""
