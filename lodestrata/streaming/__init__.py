"""Part of lodestrata: streaming."""
