"""sources of sparkweft."""
