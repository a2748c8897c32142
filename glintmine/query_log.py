"""A log of searches: one JSON line for each, with what every stage found."""

from __future__ import annotations

import json
import os
import warnings
from datetime import UTC, datetime
from pathlib import Path

FOLDER, FILE = "glintmine", "query_log.jsonl"
STAGES = ("fts", "vec", "concatenated", "reranked")


def log_path(data_home: str | None, home: str) -> Path:
    """Under the user's data folder, or where that is by custom."""
    return (Path(data_home) if data_home else Path(home) / ".local" / "share") / FOLDER / FILE


def path_from_env() -> Path | None:
    home = os.environ.get("HOME")
    return log_path(os.environ.get("XDG_DATA_HOME"), home) if home else None


def record(query: str, outcome, milliseconds: int, version: str) -> dict:
    hits = lambda df: [{"chunk_id": r["chunk_id"], "score": r["score"], "source": r["source"]} for r in df.collect()]
    stages = {f"{name}_results": hits(outcome.stages[name]) if name in outcome.stages else [] for name in STAGES}
    ids = [r["chunk_id"] for r in outcome.results.orderBy("rank").select("chunk_id").collect()]
    return {"timestamp": datetime.now(UTC).isoformat(), "version": version, "original_query": query, **stages, "final_context_ids": ids, "latency_ms": milliseconds}


def append(path: Path | None, told: dict) -> bool:
    """Appends a line; a log that can't be written is a warning, never an error of the search."""
    if path is None:
        warnings.warn("no home folder for the query log", stacklevel=2)
        return False
    try:
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("a", encoding="utf-8") as file:
            file.write(json.dumps(told, ensure_ascii=False) + "\n")
    except OSError as e:
        warnings.warn(f"query log: {e}", stacklevel=2)
        return False
    return True
