"""Whole jobs: corpus builds, mixture recipes, driver queries and their oracle SQL."""
