"""Readers and writers: raw chunks, seeds, marts, signals and gateway envelopes."""
