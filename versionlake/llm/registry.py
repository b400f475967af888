"""All queries of this subpackage and their SQL."""

from . import ann, bpe, conversations, decontam, exact_dedup, jaccard, licenses, merkle, packing, pii, toxicity, urls, warc  # noqa: F401
from .common import QUERIES, SQL  # noqa: F401
