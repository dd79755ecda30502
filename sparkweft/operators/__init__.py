"""operators of sparkweft."""
