"""Where graphs come from."""

from .graph import RevGraph
from .tables import order_graph, read_graph, read_table, write_graph

__all__ = ["RevGraph", "order_graph", "read_graph", "read_table", "write_graph"]
