"""streaming of provgraph."""
