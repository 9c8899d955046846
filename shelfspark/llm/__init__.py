"""Training-data operators: identification, dedup, scans, scoring, formatting and packing."""
