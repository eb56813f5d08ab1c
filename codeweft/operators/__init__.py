"""operators of codeweft."""
