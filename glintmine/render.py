"""Answers as JSON lines and as text. All take collected rows (dicts) of a page, a report or a bundle."""

from __future__ import annotations

import json
from itertools import groupby

UNNAMED = "(unnamed)"
TEXT_ONLY = "Note: degraded mode — FTS-only seed selection"


def as_json(told: dict) -> str:
    return json.dumps(told, ensure_ascii=False, separators=(",", ":"))


def _given(**values) -> dict:
    return {k: v for k, v in values.items() if v is not None}


def results(rows: list[dict], degraded: bool, notes: list[str]) -> str:
    each = [
        {"file": r["file_path"], "name": r["name"] or "", "type": r["chunk_type"], "start_line": r["start_line"], "end_line": r["end_line"], "score": r["score"], "content": r["content"], "parent_chunk_id": r["parent_chunk_id"]}
        | _given(source_kind=r.get("source_kind"), injection_flags=r.get("injection_flags"))
        for r in rows
    ]
    return as_json({"results": each, "degraded": degraded, "notes": notes, "injection_check": "ran"})


def index_run(counters: dict, coverage: str | None, degraded: bool, notes: list[str], rebuilt: bool = False) -> str:
    told = {k: counters[k] for k in ("files_processed", "chunks_created", "files_skipped", "files_errored") if not (rebuilt and k == "files_skipped")}
    return as_json(told | _given(coverage=coverage) | {"degraded": degraded, "notes": notes})


def dry_run(counters: dict, degraded: bool, notes: list[str]) -> str:
    return as_json(counters | {"degraded": degraded, "notes": notes})


def status(stats: dict, last_indexed: str | None) -> str:
    told = {"files": stats["total_files"], "chunks": stats["total_chunks"], "embedded_chunks": stats["embedded_chunks"], "embeddable_chunks": stats["embeddable_chunks"], "embed_percentage": stats["coverage_percent"], "references": stats["references"]}
    return as_json(told | {"last_indexed": last_indexed, "degraded": False, "notes": []})


def impact(target: str, known: bool, dependents: list[dict], symbol_refs: list[str], related: list[dict]) -> str:
    each = [{"file_path": d["file_path"], "depth": d["depth"], "references": [{"ref_kind": r["ref_kind"], "via_symbol": r["via_symbol"]} for r in d["references"]]} for d in dependents]
    told = {"target": target, "in_index": known, "dependents": each, "symbol_refs": symbol_refs}
    if related:
        told["semantic_related"] = [{"file_path": r["file_path"], "score": r["score"]} for r in related]
    return as_json(told | {"total": len(each), "degraded": False, "notes": []})


def brief(rows: list[dict], degraded: bool) -> str:
    each = [
        {"file_path": r["file_path"], "start_line": r["start_line"], "end_line": r["end_line"], "chunk_type": r["chunk_type"], "content": r["content"], "included_reason": r["reason"]}
        | _given(source_kind=r.get("source_kind"), injection_flags=r.get("injection_flags"))
        for r in rows
    ]
    return as_json({"degraded": degraded, "chunks": each, "injection_check": "ran"})


def brief_text(rows: list[dict], degraded: bool) -> str:
    body = "\n---\n".join(f"{r['file_path']}:{r['start_line']}-{r['end_line']}\n{r['content']}" for r in rows)
    return "\n".join(x for x in (TEXT_ONLY if degraded else "", body) if x)


def _named(row: dict) -> str:
    return f"{row['name'] or UNNAMED} [{row['chunk_type']}]"


def grouped(rows: list[dict], notes: list[str]) -> str:
    """Enriched results by file, files by their best score, ranks as they were."""
    out = []
    for path, group in groupby(rows, key=lambda r: r["file_path"]):
        some = list(group)
        lines = [f"## {path}"]
        if imports := [x for x in (some[0]["imports"] or "").split("\n") if x]:
            lines.append(f"Imports: {', '.join(imports)}")
        if some[0]["siblings"]:
            lines.append(f"Siblings: {', '.join(_named(s) for s in some[0]['siblings'])}")
        lines.append("")
        for r in some:
            lines += [f"{r['rank']}. {_named(r)} — {r['start_line']}:{r['end_line']} (similarity: {r['score']:.2f})", r["content"], ""]
            if (parent := r["parent"]) is not None:
                lines += [f"  Parent context: {_named(parent)} — {parent['start_line']}:{parent['end_line']}", parent["content"], ""]
        out.append("\n".join(lines) + "\n")
    return "".join(out) + "".join(f"\n---\nNote: {n}\n" for n in notes)


def nothing_found(coverage: str, notes: list[str]) -> str:
    return "".join([f"No results found. Index coverage: {coverage}. Repeat search to expand embedding coverage.", *(f"\n\nNote: {n}" for n in notes)])


def impact_text(target: str, dependents: list[dict], symbol_refs: list[str] | None, related: list[dict]) -> str:
    """By depth; with a symbol (``symbol_refs`` given), what refers to it comes first."""
    out = [f"## Impact analysis: `{target}`\n"]
    mark = "###"
    if symbol_refs is not None:
        if symbol_refs:
            out += ["### Direct symbol references", *(f"- {f}" for f in symbol_refs)]
        out += ["", "### All transitive dependents"]
        mark = "####"
    elif related:
        out.append("### Structural dependents (import graph)")
        mark = "####"
    for depth, group in groupby(dependents, key=lambda d: d["depth"]):
        out += [f"{mark} Depth {depth}", *(f"- {d['file_path']}" for d in group)]
    if related:
        out += ["", "### Semantic related (embedding search)", *(f"- {r['file_path']} (similarity: {r['score']:.2f})" for r in related)]
    return "\n".join([*out, "", f"Total: {len(dependents)} dependent file(s)", ""])


def recall(repo: str, aggregate: dict, entries: list[dict]) -> str:
    return as_json({"repo": repo, "aggregate": aggregate, "entries": entries})


def recall_text(repo: str, aggregate: dict, entries: list[dict]) -> str:
    word = lambda x: str(x).lower()
    rates = lambda r: f"recall={r['recall']:.3f} cap_fit={r['cap_fit']:.3f}"
    lines = [f"recall report: {repo} (degraded: {word(aggregate['degraded'])})", f"  aggregate: {rates(aggregate)} over {len(entries)} entries"]
    return "\n".join([*lines, *(f"  {e['id']:<40} {rates(e)}{' (degraded)' if e['degraded'] else ''}" for e in entries), ""])
