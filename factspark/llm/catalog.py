"""All registered queries of this subpackage."""

from factspark.llm import (bpe, chat, decontamination, embedding_dedup, language_id, mixing, ngram_lm, periodic_runs, quality, secrets, simhash,  # noqa: F401
                           toxicity, vector_codes)
from factspark.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
