"""Metadata of a graph archive and what is planned from it before any data is read."""
