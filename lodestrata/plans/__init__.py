"""Part of lodestrata: plans."""
