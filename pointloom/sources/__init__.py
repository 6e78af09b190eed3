"""Readers and writers of point clouds and meshes."""
