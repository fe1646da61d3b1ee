"""Streaming of the paired-evaluation engine."""
