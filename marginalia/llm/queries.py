"""All corpus queries; importing this module registers them."""

from marginalia.llm import (  # noqa: F401  (imports register queries)
    bpe, collision_search, compression_quality, covering_dedup, curve_packing, importance, kernel_toxicity, licenses, mixing,
    periodic, pseudonyms, syncmers, url_trust,
)
from marginalia.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
