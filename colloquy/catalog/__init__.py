"""Named queries over the sample tables, each with the SQL it has to agree with."""

from colloquy.catalog.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
