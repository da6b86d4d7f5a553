"""All queries of the corpus operators."""

from __future__ import annotations

from . import arc_convert, chat_format, decontaminate, kneser_ney, line_dedup, mixing, order_minhash, resharding, suffix_dedup, weak_rules

MODULES = [chat_format, arc_convert, decontaminate, mixing, order_minhash, line_dedup, kneser_ney, suffix_dedup, weak_rules, resharding]
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
