"""plans of sparkweft."""
