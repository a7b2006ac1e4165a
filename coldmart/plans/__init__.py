"""Whole results: staging, the star, and what is asked of it."""
