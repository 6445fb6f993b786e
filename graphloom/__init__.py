"""Spark-native property-graph analytics: typed nodes, typed multi-edges, flow graphs and change streams."""
