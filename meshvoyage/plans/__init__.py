"""Configuration and the plans that compose operators into whole jobs."""
