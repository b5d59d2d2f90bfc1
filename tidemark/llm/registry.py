"""Queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import filter_audit, parts, quote_link
from .bagminhash import op9_bagminhash
from .decontaminate import op8_decontaminate
from .filter_audit import op12_filter_audit
from .imatch import op2_imatch
from .quote_link import op10_quote_link
from .secret_scan import op4_secret_scan
from .simhash_golay import op13_simhash_golay
from .site_quality import op6_site_quality
from .source_mix import op7_source_mix
from .token_shards import op1_token_shards
from .toxicity import op3_toxicity
from .url_rules import op5_url_rules
from .whitening import op11_whitening

QUERIES = {
    "op1_token_shards": op1_token_shards,
    "op2_imatch": op2_imatch,
    "op3_toxicity": op3_toxicity,
    "op4_secret_scan": op4_secret_scan,
    "op5_url_rules": op5_url_rules,
    "op6_site_quality": op6_site_quality,
    "op7_source_mix": op7_source_mix,
    "op8_decontaminate": op8_decontaminate,
    "op9_bagminhash": op9_bagminhash,
    "op10_quote_link": op10_quote_link,
    "op11_whitening": op11_whitening,
    "op12_filter_audit": op12_filter_audit,
    "op13_simhash_golay": op13_simhash_golay,
    **parts.QUERIES,
}

SQL: dict[str, str] = {"op10_quote_link": quote_link.SQL, "op12_filter_audit": filter_audit.SQL, **parts.SQL}
