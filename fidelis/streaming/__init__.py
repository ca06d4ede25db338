"""Streaming front ends over the same operators."""
