"""Streams: projection onto the frozen frame, rates in windows, births of communities, bursts."""
