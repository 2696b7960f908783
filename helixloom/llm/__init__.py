"""Training-data operators: decontamination, near-duplicates, filters, tokenising, chat, scoring, extraction."""
