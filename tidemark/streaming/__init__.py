"""Streams: event time against arrival, late data, state for each key."""
