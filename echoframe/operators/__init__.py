"""Operators on rasters, pulses and points."""
