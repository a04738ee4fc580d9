"""Preparing text corpora for training: scoring, filtering, deduplication, mixing, sharding and packing."""
