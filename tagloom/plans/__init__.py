"""Configured stages and their runner."""
