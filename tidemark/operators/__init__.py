"""Operators over dated frames: (series_id, month, value) unless they say otherwise."""
