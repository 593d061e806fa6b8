"""Part of lodestrata: operators."""
