"""larkstead.sources."""
