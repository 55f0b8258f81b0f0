"""Training-data operators: language models, fingerprints, packing, scans, filters and mixing."""
