"""One query of many parts over records, and records as a short transcript."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.distances import cosine

# Marks of event types, and the fields of an event that say what it did, the first that has text.
GLYPHS = {"prompt": "▸", "edit": "✎", "read": "▪", "search": "⌕", "run": "$", "test": "✓", "other": "·", "code_change": "✎"}
DETAIL_FIELDS = ("command", "file_path", "text", "description", "tool", "content")


def matches(df: DataFrame, where: list[str] = (), text: Column | None = None, grep: str | None = None, time: Column | None = None, since: str | None = None, until: str | None = None) -> Column:
    """All given conditions at once: `field=value` (null for none), a regular expression in any case on `text`, and a window [since, until] of time."""
    out = F.lit(True)
    for clause in where:
        field, sep, value = clause.partition("=")
        if not sep:
            raise ValueError(f"not field=value: {clause}")
        own = F.col(f"`{field}`").cast("string") if field in df.columns else F.lit(None).cast("string")
        out = out & F.coalesce(own == value, F.lit(value == "null"))
    if grep is not None:
        out = out & F.coalesce(text.rlike("(?i)" + grep), F.lit(False))
    if since is not None:
        out = out & F.coalesce(time >= F.lit(since).cast("timestamp"), F.lit(False))
    if until is not None:
        out = out & F.coalesce(time <= F.lit(until).cast("timestamp"), F.lit(False))
    return out


def search(df: DataFrame, condition: Column, vector: list[float] | None = None, embedding: str = "embedding", key: str = "id", top_k: int = 20, min_score: float | None = None, limit: int | None = None) -> DataFrame:
    """df and score: records under the condition; with a vector the top_k most similar ones, or all of at least min_score, best first, ties by key.

    Filters come before similarity, in one plan, so they reach the scan. Without a vector the score is null and the order that of df."""
    found = df.where(condition)
    if vector is None:
        out = found.withColumn("score", F.lit(None).cast("double"))
        return out if limit is None else out.limit(limit)
    scored = found.withColumn("score", cosine(F.col(embedding), F.array(*map(F.lit, vector))))
    scored = scored.where(F.col("score") >= min_score) if min_score is not None else scored
    n = limit if min_score is not None else top_k if limit is None else min(top_k, limit)
    ranked = scored.orderBy(F.desc("score"), key)
    return ranked if n is None else ranked.limit(n)


def clip(text: str, width: int) -> str:
    return text if len(text) <= width else text[: width - 1] + "…"


def label(event: dict[str, Any]) -> str:
    """What an event did, on one line."""
    details = event.get("details") or {}
    found = next((v for v in (details.get(k) for k in DETAIL_FIELDS) if isinstance(v, str) and v.strip()), "")
    return " ".join(found.split())


def transcript(record: dict[str, Any], width: int = 88, examples: int = 3) -> str:
    """A record as text: a heading, each prompt, and each run of one type of event with its first examples. For the few records that are shown."""
    events = record.get("events") or []
    times = [e["timestamp"] for e in events if e.get("timestamp")]
    head = [record.get("instance_id", "?"), record.get("agent"), record.get("cwd") or record.get("repo")]
    lines = [" ".join(str(x) for x in head if x), f"{len(events)} events" + (f"  {times[0][:19]} .. {times[-1][:19]}" if times else "")]
    at = 0
    while at < len(events):
        kind = events[at].get("type", "other")
        if kind == "prompt":
            lines += ["", f"{GLYPHS['prompt']} {clip(label(events[at]) or '(empty prompt)', width - 2)}"]
            at += 1
            continue
        end = at
        while end < len(events) and events[end].get("type", "other") == kind:
            end += 1
        n = end - at
        detail = ", ".join(clip(x, 40) for x in map(label, events[at : min(end, at + examples)]) if x) + (f", +{n - examples} more" if n > examples else "")
        lines.append(f"    {GLYPHS.get(kind, '·')} {kind:<6}{f'×{n}' if n > 1 else '  '}  {clip(detail, width - 20)}")
        at = end
    return "\n".join(lines)


def show(df: DataFrame, key: str | None = None, limit: int = 5, width: int = 88) -> str:
    """Transcripts of the first records (or those of one instance_id), as many as the limit; raises if there are none."""
    some = df.where(F.col("instance_id") == key) if key is not None else df
    rows = [r.asDict(recursive=True) for r in some.limit(limit).collect()]
    if not rows:
        raise ValueError(f"no record {key!r}" if key is not None else "no records")
    return ("\n\n" + "─" * width + "\n").join(transcript(r, width) for r in rows)
