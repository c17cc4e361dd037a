"""Part of stackmill."""
