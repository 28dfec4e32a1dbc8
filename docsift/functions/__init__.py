"""Column expressions: text, JSON values, field rules, previews, fingerprints."""
