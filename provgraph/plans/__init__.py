"""plans of provgraph."""
