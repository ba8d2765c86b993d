"""Column-level building blocks (dates, seeded draws, KL, size-checked joins)."""
