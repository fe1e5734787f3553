"""Operators on grids, costs, sites, paths and networks, as DataFrame jobs over (r, c) cells."""
