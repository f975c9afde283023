"""Training-data operators: extraction, counting, filtering, matching and packing of documents."""
