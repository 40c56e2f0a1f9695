from .edges import edge_table, edges_from_tables, read_assignment, read_parquet, write_edges, write_graph

__all__ = ["edge_table", "edges_from_tables", "read_assignment", "read_parquet", "write_edges", "write_graph"]
