"""Training-data operators: de-duplication, fingerprints, classifiers, PII, WARC, sharding, tokens, packing, search."""
