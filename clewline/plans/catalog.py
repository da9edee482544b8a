"""All registered queries; importing a module registers its queries."""
from . import q_brand, q_feeds, q_infra, q_netlog, q_pages, q_records, q_streams, q_transport, q_urls  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
