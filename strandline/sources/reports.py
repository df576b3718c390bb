"""Reports: tables of sections, a canonical JSON of bounded sections, a short hand-out and the gate."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sections(sections: dict[str, DataFrame], out: str) -> None:
    """Each section as a Parquet table under out, written by Spark."""
    for name, df in sections.items():
        df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}")


def canonical_json(section: DataFrame, order: list[str], most: int) -> str:
    """The first `most` rows in order as JSON: sorted keys, compact, NaN refused, a newline at the end."""
    rows = [r.asDict(recursive=True) for r in section.orderBy(*order).limit(most).collect()]
    return json.dumps(rows, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n"


def hand_out(ranked: DataFrame, title: str, group: str, rank: str = "rank", most: int = 10) -> str:
    """Markdown of the first rows of each group."""
    lines = [f"# {title}"]
    last = None
    for r in ranked.where(F.col(rank) <= most).orderBy(group, rank).collect():
        if r[group] != last:
            lines += ["", f"## {r[group]}", ""]
            last = r[group]
        lines.append("- " + ", ".join(f"{k} {v}" for k, v in r.asDict().items() if k not in (group, rank)))
    return "\n".join(lines) + "\n"


def gate(regressions: dict[str, DataFrame], fail_on: tuple[str, ...]) -> int:
    """3 if any of the chosen tables has a row, else 0."""
    return 3 if any(not regressions[k].isEmpty() for k in fail_on) else 0
