"""Training-data operators: mixing, filtering, extraction, fingerprints, archives and near-duplicate search."""
