"""Readers, raw-edge normalisation and sinks."""
