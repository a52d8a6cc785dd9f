"""Readers and writers (S1-S16) and the driver-table loaders."""
