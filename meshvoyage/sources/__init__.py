"""Readers of meshes, waypoints and routes, synthetic fields, and writers of results."""
