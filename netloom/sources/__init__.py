"""Readers that turn source records into node and edge tables."""
