"""Column expressions: text, patterns, levels, findings, models."""
