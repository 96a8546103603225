"""Operators over vertex and edge frames: ids, access, traversal, algorithms, updates, transformation, validation."""
