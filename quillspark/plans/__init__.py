"""Part of the library: plans."""
