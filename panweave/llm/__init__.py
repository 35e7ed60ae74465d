"""Training-data operators: quality, licences, media, token counts, dedup, BPE, packing, language, toxicity."""
