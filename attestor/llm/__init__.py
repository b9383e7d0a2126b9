"""Training-data operators: scans, tokenizers, sketches, deduplication, classifiers, packing, search."""
