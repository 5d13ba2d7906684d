"""calspar operators."""
