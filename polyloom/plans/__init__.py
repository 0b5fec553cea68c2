"""Building blocks that shape physical plans: shared tables, Bloom prefilters, fixpoints."""
