"""streaming of sparkweft."""
