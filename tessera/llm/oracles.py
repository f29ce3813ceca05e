"""DuckDB SQL for the queries of this package that SQL expresses."""

from __future__ import annotations

from tessera.llm.licenses import scan_sql
from tessera.llm.lines import report_sql
from tessera.llm.near import near_sql
from tessera.llm.quality import assess_sql

ORACLES: dict[str, str] = {
    "op4_line_dedup": report_sql(),
    "op5_minhash_near_dedup": near_sql(),
    "op9_license_scans": scan_sql(),
    "op10_quality_rules": assess_sql(),
}
