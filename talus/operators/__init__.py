"""Operators over points, cells, flow graphs, classes and zones."""
