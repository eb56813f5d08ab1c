"""plans of codeweft."""
