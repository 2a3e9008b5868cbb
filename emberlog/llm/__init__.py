"""Training-data operators: dedup, filters, language ID, packing and decontamination."""
