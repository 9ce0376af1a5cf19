"""Training-data operators: formatting, near-duplicate search, scoring, filtering, sharding, packing and archives."""
