"""Training-data operators: scans, near-duplicates, packing, token files, classifiers."""
