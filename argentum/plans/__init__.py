"""The library facade and its composed plans."""
