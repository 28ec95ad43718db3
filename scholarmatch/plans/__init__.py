"""Registered queries: the operators bound to the driver tables, with their SQL oracles.

Every module here exposes ``QUERIES`` (name -> callable(spark, sf_dir)) and
``ORACLES`` (name -> DuckDB SQL).
"""

from importlib import import_module

_MODULES = (
    "discovery",
    "directory",
    "papers",
    "people",
    "contacts",
    "insight",
    "grounding",
    "documents",
    "operations",
    "feeds",
    "streams",
)


def all_queries():
    found = {}
    for name in _MODULES:
        found.update(import_module(f"{__name__}.{name}").QUERIES)
    return found


# DuckDB widens sums and ranks; these columns are brought back to the width of the Spark result.
_WIDTHS = {
    "disambig_eval": {"tp": "BIGINT", "fp": "BIGINT", "fn": "BIGINT", "tn": "BIGINT"},
    "normalize_names_counts": {"renamed": "BIGINT", "merged": "BIGINT"},
    "page_freshness": {"hits": "BIGINT"},
    "retention_totals": {"bytes": "BIGINT", "orphan_bytes": "BIGINT"},
    "stream_trace_sessions": {"duration_ms": "BIGINT"},
    "stream_trace_sliding": {"duration_ms": "BIGINT"},
    "stream_trace_windows": {"duration_ms": "BIGINT"},
    "trace_rollup": {"tokens": "BIGINT", "duration_ms": "BIGINT"},
    "assess_identity": {"score": "INTEGER"},
    "catalog_io": {"n_origins": "INTEGER"},
    "compare_table": {"rank": "INTEGER"},
    "group_assessment": {"n_members": "INTEGER"},
    "hybrid_rank": {"rank": "INTEGER", "match_score": "INTEGER"},
    "page_links": {"pos": "INTEGER"},
    "page_text": {"n_chars": "INTEGER"},
    **{q: {"rank": "INTEGER", "match_score": "INTEGER"} for q in ("rank_candidates", "index_rank", "index_update")},
    "section_facts": {"pos": "INTEGER"},
    "source_coverage": {"rank": "INTEGER"},
    "vector_recall": {"rank": "INTEGER"},
    "template_draft": {"idx": "INTEGER"},
    "fit_end_to_end": {"sentences": "BIGINT", "removed": "BIGINT"},
    **{
        q: {"year": "INTEGER"}
        for q in (
            "conform_arxiv", "conform_crossref", "conform_dblp", "conform_europepmc", "conform_openalex", "conform_scopus",
            "conform_springer", "conform_wanfang", "ledger_works", "merge_works", "work_keys", "works_by_doi", "works_by_topic",
        )
    },
}


def all_oracles():
    found = {}
    for name in _MODULES:
        found.update(import_module(f"{__name__}.{name}").ORACLES)
    for query, widths in _WIDTHS.items():
        casts = ", ".join(f'"{c}"::{t} AS "{c}"' for c, t in widths.items())
        found[query] = f"SELECT * REPLACE ({casts}) FROM ({found[query]}) AS q"
    return found
