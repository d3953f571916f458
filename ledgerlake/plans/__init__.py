"""The store: a table of versions with commits, snapshots and recovery."""
