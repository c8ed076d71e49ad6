"""Training-data operators: mixing, quality rules, near-duplicates, language, lines, toxicity,
HTML, decontamination, repeated passages and token counts. Nothing else in the library imports this."""
