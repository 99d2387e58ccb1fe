"""Column functions of provgraph."""
