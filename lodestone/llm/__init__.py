"""Training-data operators: packing, near-duplicates, language ID, token counts, quality, media, LM scoring, encoding, ANN, WARC."""
