"""larkstead.streaming."""
