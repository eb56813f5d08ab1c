"""functions of codeweft."""
