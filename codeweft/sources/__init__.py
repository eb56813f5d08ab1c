"""sources of codeweft."""
