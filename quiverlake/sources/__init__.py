"""Readers: control files, vertex and edge chunks, whole graphs, imports."""
