"""Refreshing a graph from a stream of changed files."""
