"""Versioned key-value analytics on Spark: changelogs, snapshots, runs, logs, manifests."""

__version__ = "0.1.0"
