"""DuckDB oracle SQL for the registered queries (correctness gate only).

Written independently of the Spark plans: brute-force self joins for focal
windows and nearest cells, gaps-and-islands for spells, literal grids for
threshold sweeps. Doubles are rounded to 6 decimals like the Spark side.
"""
