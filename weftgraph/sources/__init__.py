"""Graphs: tables mapped to labelled nodes and typed relationships, and the versioned store."""
