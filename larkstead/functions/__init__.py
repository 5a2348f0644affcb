"""larkstead.functions."""
