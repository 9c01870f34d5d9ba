"""Operators: DataFrames of cells, edges, waypoints, routes and legs in and out."""
