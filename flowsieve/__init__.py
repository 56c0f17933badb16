"""Dataflow analysis over labelled graphs that are stored as tables."""
