"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from .alignment import op11_alignment
from .decontaminate import op2_decontaminate
from .digests import op5_digests
from .langid import op1_langid
from .licenses import op13_licenses
from .mixing import op3_mixing
from .ngrams import op10_ngrams
from .pii import op4_pii
from .secrets import op8_secrets
from .simhash import op9_simhash
from .sql import QUERIES, SQL
from .substrings import op6_substrings
from .warc import op7_warc
from .whitening import op12_whitening


def queries() -> dict:
    return {
        "op1_langid": op1_langid,
        "op2_decontaminate": op2_decontaminate,
        "op3_mixing": op3_mixing,
        "op4_pii": op4_pii,
        "op5_digests": op5_digests,
        "op6_substrings": op6_substrings,
        "op7_warc": op7_warc,
        "op8_secrets": op8_secrets,
        "op9_simhash": op9_simhash,
        "op10_ngrams": op10_ngrams,
        "op11_alignment": op11_alignment,
        "op12_whitening": op12_whitening,
        "op13_licenses": op13_licenses,
        **QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of what it can express; tests/llm holds the rest against brute force, a round trip or held-out accuracy."""
    return dict(SQL)
