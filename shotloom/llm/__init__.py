"""Training-data operators over document tables: deduplication, token counts, classifiers, scans, mixing and packing."""
