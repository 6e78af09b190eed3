"""DataFrame operators over point clouds, meshes and neighbour graphs."""
