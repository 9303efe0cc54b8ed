"""Scans, adapters, sinks and stored artefacts."""
