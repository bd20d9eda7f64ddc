"""Composed pipelines (one survey run, sweeps, grids) and the query catalog."""
