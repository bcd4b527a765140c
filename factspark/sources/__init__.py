"""Readers and writers for workspaces, snapshots, artifacts and usage rows."""
