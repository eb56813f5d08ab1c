"""streaming of codeweft."""
