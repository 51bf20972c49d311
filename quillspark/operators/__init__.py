"""Part of the library: operators."""
