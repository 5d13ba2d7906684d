"""calspar functions."""
