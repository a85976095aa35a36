"""Streams: windows and sessions over events, a running duplicate filter, pruning as rows arrive."""
