"""Row-by-row delivery of results, and event streams as graph updates."""
