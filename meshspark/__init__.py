"""Spark-native engine for large triangle meshes and point clouds."""
