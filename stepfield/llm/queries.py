"""The queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from stepfield.llm import q_chat, q_decontaminate, q_importance, q_licenses, q_lines, q_lm, q_media, q_packing, q_periodic, q_quality, q_secrets, q_simhash, q_urls

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
for _module in (q_media, q_urls, q_decontaminate, q_licenses, q_chat, q_lm, q_simhash, q_secrets, q_quality, q_packing, q_importance, q_periodic, q_lines):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
