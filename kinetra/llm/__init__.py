"""Training-data operators: filters, de-duplication, mixing, packing, search and formatting."""
