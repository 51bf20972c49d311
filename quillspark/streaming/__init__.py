"""Part of the library: streaming."""
