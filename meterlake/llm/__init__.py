"""Training-data operators: quality rules, deduplication, token files, URL
filters, decontamination, packing, language identification, toxicity,
near-duplicate joins and n-gram language models."""
