"""Reversible contract plans, compiled to Column expressions over leaves."""
