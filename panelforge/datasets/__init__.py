"""Datasets: pipelines over typed tables, and loaders that read them from a catalogue."""
