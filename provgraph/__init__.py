"""provgraph: provenance-aware supply-chain graphs and data preparation on PySpark."""

__version__ = "0.1.0"
