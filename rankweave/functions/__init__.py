"""Part of rankweave."""
