"""All queries of this package; importing a module registers its queries."""
from . import bpe, chat, fill_middle, hard_negatives, html_text, jaccard_join, language, packing, quality_model, quality_rules, sharding, vectors, warc  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
