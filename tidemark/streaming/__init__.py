"""Streaming delivery."""
