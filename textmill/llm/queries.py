"""All queries of the subpackage: importing the operators registers them."""

from textmill.llm import alignment, ann, bpe, exact_search, filter_audit, lines, minhash, mixing, secrets, substrings, tokenfiles, toxicity, url_filter  # noqa: F401
from textmill.llm.registry import ORACLES, QUERIES  # noqa: F401
