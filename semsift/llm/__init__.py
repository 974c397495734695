"""Training-data operators: scans, de-duplication, scoring, formatting, mixing, packing."""
