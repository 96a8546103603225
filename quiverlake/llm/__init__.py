"""Training-data operators: search, secrets, URL rules, near-duplicates, mixing, extraction and classifiers."""
