"""operators of provgraph."""
