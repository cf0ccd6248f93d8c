"""DataFrame operators of the analyses."""
