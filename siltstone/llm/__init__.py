"""Training-data operators (leaks, overlaps, splitting, duplicates, quality, language, splits, packing, mixing, spam)."""
