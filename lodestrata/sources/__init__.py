"""Part of lodestrata: sources."""
