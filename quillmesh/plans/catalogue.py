"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from quillmesh.plans import answer_plan, evidence_plan, feed_plan, message_plan, page_plan, text_plan, urls_plan

MODULES = (urls_plan, feed_plan, text_plan, message_plan, answer_plan, evidence_plan, page_plan)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
