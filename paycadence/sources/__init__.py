"""Adapters that turn stored tables into the canonical frames, and report sinks."""
