"""Packs file corpora into ordered text documents with Spark."""

from packmill.options import PackOptions
from packmill.plans.pack import Pack, pack_directory, pack_table

__all__ = ["Pack", "PackOptions", "pack_directory", "pack_table"]
