"""The command line: a verb, or a query alone for a search; answers on stdout, errors on stderr with an exit status."""

from __future__ import annotations

import argparse
import sys

from .engine import Engine, Options
from .errors import EngineError, InternalError, InvalidInput
from .operators import embedding
from .session import local_session
from .sources import config

VERBS = ("search", "index", "rebuild", "impact", "status", "brief", "recall")
GLOBAL = ("--json", "--log-query")


def between(least: int, most: int):
    def number(text: str) -> int:
        value = int(text)
        if not least <= value <= most:
            raise argparse.ArgumentTypeError(f"{value} is not in {least}..={most}")
        return value

    return number


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise InvalidInput(message)


def parser() -> argparse.ArgumentParser:
    common = _Parser(add_help=False)
    for flag, told in zip(GLOBAL, ("answer in JSON", "append a line for each search to the query log"), strict=True):
        common.add_argument(flag, action="store_true", default=argparse.SUPPRESS, help=told)
    top = _Parser(prog="glintmine", parents=[common])
    verbs = top.add_subparsers(dest="verb", required=True, parser_class=_Parser)
    s = verbs.add_parser("search", parents=[common], help="find code by meaning and by words")
    s.add_argument("query", nargs="?")
    s.add_argument("--limit", type=between(1, 100), default=10)
    s.add_argument("--offset", type=between(0, 500), default=0)
    s.add_argument("--path", action="append", default=[])
    s.add_argument("--from", dest="source")
    for name in ("index", "rebuild"):
        i = verbs.add_parser(name, parents=[common], help="update the index" if name == "index" else "build the index anew")
        i.add_argument("--dry-run", action="store_true")
        i.add_argument("--exclude-vendor", action="store_true")
    m = verbs.add_parser("impact", parents=[common], help="what depends on a file or symbol")
    m.add_argument("target")
    m.add_argument("--symbol")
    m.add_argument("--depth", type=between(0, 10), default=3)
    m.add_argument("--semantic", action="store_true")
    verbs.add_parser("status", parents=[common], help="figures of the index")
    b = verbs.add_parser("brief", parents=[common], help="the code that a task needs")
    b.add_argument("task")
    b.add_argument("--seed-file", action="append", default=[])
    b.add_argument("--seed-symbol", action="append", default=[])
    b.add_argument("--depth", type=between(1, 10), default=3)
    b.add_argument("--max-chunks", type=between(1, 1000), default=80)
    b.add_argument("--max-bytes", type=between(1000, 10_000_000), default=80_000)
    b.add_argument("--include-tests", action="store_true")
    r = verbs.add_parser("recall", parents=[common], help="measure briefs without seeds on the ground truth")
    r.add_argument("repo")
    return top


def expanded(args: list[str]) -> list[str]:
    """A query without a verb is a search."""
    plain = [a for a in args if a not in GLOBAL]
    if plain and not plain[0].startswith("-") and plain[0] not in VERBS:
        at = args.index(plain[0])
        return [*args[:at], "search", *args[at:]]
    return args


def answer(engine: Engine, given: argparse.Namespace, as_json: bool) -> tuple[str, int]:
    if given.verb == "search":
        try:
            query = config.query_of(given.query)
        except InvalidInput:
            if given.source is None:
                raise
            query = None
        return engine.search_answer(query, given.limit, given.offset, given.path, given.source, as_json), 0
    if given.verb in ("index", "rebuild"):
        run = engine.dry_run_answer if given.dry_run else engine.index_answer
        return run(given.verb == "rebuild", given.exclude_vendor, as_json), 0
    if given.verb == "impact":
        return engine.impact_answer(given.target, given.symbol, given.depth, given.semantic, as_json), 0
    if given.verb == "status":
        return engine.status_answer(as_json), 0
    if given.verb == "brief":
        return engine.brief_answer(given.task, as_json, seeds=given.seed_file, symbols=given.seed_symbol, depth=given.depth, max_chunks=given.max_chunks, max_bytes=given.max_bytes, include_tests=given.include_tests), 0
    text, degraded = engine.recall_answer(given.repo, as_json)
    return text, int(degraded)


def put(text: str, stream=None) -> int:
    """Writes an answer; a reader that has gone away is no error."""
    stream = stream or sys.stdout
    try:
        stream.write(text if text.endswith("\n") else text + "\n")
        stream.flush()
    except BrokenPipeError:
        return 0
    return 0


def main(args: list[str] | None = None, spark=None, embedder: embedding.Embedder | None = None, root: str | None = None) -> int:
    try:
        given = parser().parse_args(expanded(sys.argv[1:] if args is None else args))
    except InvalidInput as e:  # before it is known that JSON is wanted
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code
    as_json = getattr(given, "json", False)
    try:
        engine = Engine(spark or local_session(), root or config.find_root("."), embedder or embedding.HashEmbedder(), options=Options.from_env(log=getattr(given, "log_query", False)))
        text, status = answer(engine, given, as_json)
    except Exception as e:
        error = e if isinstance(e, EngineError) else InternalError(str(e))
        print(error.envelope() if as_json else f"error: {error}", file=sys.stderr)
        return error.exit_code
    return put(text) or status


if __name__ == "__main__":
    sys.exit(main())
