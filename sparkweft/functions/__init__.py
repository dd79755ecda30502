"""functions of sparkweft."""
