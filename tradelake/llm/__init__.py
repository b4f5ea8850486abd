"""Training-data operators: decontamination, language id, token counts, near-dedup, WARC and the like."""
