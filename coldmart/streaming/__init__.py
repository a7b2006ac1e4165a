"""Stateful jobs: each has a batch form over history and a Structured Streaming form."""
