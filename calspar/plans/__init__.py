"""calspar plans."""
