"""larkstead.plans."""
