"""Training-data operators: media, dedup, formatting, mixing, packing, classification and scanning."""
