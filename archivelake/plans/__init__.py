"""The archive handle and the builder."""
