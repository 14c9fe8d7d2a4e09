"""Training-data pipeline operators (mixing, deduplication, classifiers, packing, scans, searches)."""
