"""Typed sources, sinks and stages."""
