"""Readers of texts, configurations and model bundles, and the result sink."""
