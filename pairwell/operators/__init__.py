"""Operators of the paired-evaluation engine."""
