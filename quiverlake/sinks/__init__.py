"""Writers: chunk files, vertices, edges, whole graphs, in-memory builders."""
