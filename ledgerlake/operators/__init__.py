"""Relational operators over changelogs, logs, runs and manifests."""
