"""DataFrame operators: normalise, number, join on hot keys, deduplicate, split, check."""
