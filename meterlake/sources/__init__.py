"""Scans, sinks and the adapters that give driver tables their meter roles."""
