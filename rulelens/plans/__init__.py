"""Whole-run plans and the building blocks they share: storage, skew-safe joins, large top-n."""
