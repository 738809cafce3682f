"""Training-data operators: quality, mixing, licences, language model, toxicity, personal data, packing, near duplicates."""
