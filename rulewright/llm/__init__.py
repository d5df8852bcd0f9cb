"""Training-data operators: de-duplication, filtering, scanning, tokenising and packing."""
