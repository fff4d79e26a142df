"""Structural analytics on Spark: basins, neighbour graphs, replay of history, accessibility scores and their statistics."""
