"""Part of textward."""
