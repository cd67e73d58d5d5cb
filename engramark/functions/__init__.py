"""Part of engramark."""
