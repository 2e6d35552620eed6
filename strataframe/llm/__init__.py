"""Training-data operators: quality, language, URLs, near copies, packing, tokens."""
