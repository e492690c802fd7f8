"""Physical-plan helpers: checked broadcasts, skew-safe joins, block prefixes, lineage."""
