"""sources of provgraph."""
