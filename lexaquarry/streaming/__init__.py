"""Indexes that follow a stream."""
