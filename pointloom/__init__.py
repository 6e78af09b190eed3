"""pointloom: point-cloud, mesh and neighbour-graph analytics as PySpark DataFrame operators."""
