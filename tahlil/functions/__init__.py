"""Part of tahlil."""
