"""Structured Streaming: the landing-folder pipeline."""
