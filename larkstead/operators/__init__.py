"""larkstead.operators."""
