"""What a project says about itself: its root, aliases, crate name, ignored paths; and reads that may fail."""

from __future__ import annotations

import json
import os
import re
import sys
import warnings
from pathlib import Path

from ..errors import InputOutput, InvalidInput

#: The folder of an index within its project.
INDEX_FOLDER = ".glintmine"


def find_root(start: str) -> str:
    """The nearest folder at or above ``start`` that has an index, else the nearest with a repository, else itself."""
    here = Path(start).resolve()
    for marker in (INDEX_FOLDER, ".git"):
        for folder in (here, *here.parents):
            if (folder / marker).is_dir():
                return str(folder)
    return str(here)


def read_text(path: str) -> str | None:
    """A file's text; None silently where there is no such file, and with a warning where it can't be read."""
    try:
        return Path(path).read_text(encoding="utf-8")
    except FileNotFoundError:
        return None
    except (OSError, UnicodeDecodeError) as e:
        warnings.warn(f"can't read {path}: {e}", stacklevel=2)
        return None


def modified(path: str) -> int | None:
    """Seconds since 1970 of a file's last change; None for no file, and with a warning for times before."""
    try:
        seconds = os.stat(path).st_mtime
    except FileNotFoundError:
        return None
    except OSError as e:
        warnings.warn(f"can't read the time of {path}: {e}", stacklevel=2)
        return None
    if seconds < 0:
        warnings.warn(f"{path} was changed before 1970", stacklevel=2)
        return None
    return int(seconds)


def aliases(tsconfig: str | None) -> list[tuple[str, str]]:
    """(prefix, target) of the paths with a star in a tsconfig.json, targets from its baseUrl on; what is after a
    target's last slash stays as it is. Without such a file, or one that can be read, there are none."""
    try:
        options = json.loads(tsconfig or "")["compilerOptions"]
        paths = options["paths"].items()
    except (ValueError, KeyError, TypeError, AttributeError):
        return []
    base = options.get("baseUrl")
    base = re.sub(r"^(\./)+|/+$", "", base) if isinstance(base, str) else ""
    start = f"{base}/" if base not in ("", ".") else ""
    found = []
    for name, targets in sorted(paths):
        target = targets[0] if isinstance(targets, list) and targets else None
        if name.endswith("*") and isinstance(target, str) and target.endswith("*"):
            found.append((name[:-1], start + target[:-1]))
    return found


def crate_name(cargo: str | None) -> str | None:
    """The package's name in a Cargo.toml, as code writes it."""
    section = re.search(r"^[ \t]*\[[ \t]*package[ \t]*\][ \t]*$(.*?)(?=^[ \t]*\[[^\n]*\][ \t]*$|\Z)", cargo or "", re.M | re.S)
    name = re.search(r'^[ \t]*name[ \t]*=[ \t]*"([^"\n]*)"', section[1], re.M) if section else None
    return name[1].replace("-", "_") if name else None


class Ignored:
    """The rules of ignore files, from the root down: the last rule that fits a path decides."""

    def __init__(self, rules: list[tuple[str, re.Pattern, bool, bool]] | None = None):
        self.rules = rules or []

    def within(self, folder: str, text: str | None) -> Ignored:
        """These rules and those that an ignore file in ``folder`` (relative, "" for the root) adds."""
        added = [r for line in (text or "").splitlines() if (r := rule(folder, line)) is not None]
        return Ignored(self.rules + added) if added else self

    def __call__(self, path: str, is_folder: bool) -> bool:
        for base, pattern, wanted, folders in reversed(self.rules):
            if folders and not is_folder or base and not path.startswith(base + "/"):
                continue
            if pattern.fullmatch(path[len(base) + 1 :] if base else path):
                return not wanted
        return False


def rule(folder: str, line: str) -> tuple[str, re.Pattern, bool, bool] | None:
    """(folder, pattern of paths below it, whether it takes paths back in, whether it is of folders only)."""
    line = line.rstrip("\r\n")
    line = line.rstrip(" \t") if not line.endswith("\\ ") else line
    if not line or line.startswith("#"):
        return None
    wanted = line.startswith("!")
    glob = line[1:] if wanted else line.removeprefix("\\") if line[:2] in ("\\#", "\\!") else line
    folders, glob = glob.endswith("/"), glob.rstrip("/")
    anchored = "/" in glob
    glob = glob.lstrip("/")
    if not glob:
        return None
    return folder, re.compile(("" if anchored else "(?:.*/)?") + _pattern(glob)), wanted, folders


def _pattern(glob: str) -> str:
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out, k = out + "(?:.*/)?", k + 3
        elif glob[k:] == "**" and (k == 0 or glob[k - 1] == "/"):
            out, k = out + ".+", k + 2
        elif glob[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif glob[k] == "?":
            out, k = out + "[^/]", k + 1
        elif glob[k] == "[" and (end := glob.find("]", k + 2)) > 0:
            inner = glob[k + 1 : end]
            out += "[" + ("^/" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            k = end + 1
        else:
            k += glob[k] == "\\" and k + 1 < len(glob)
            out, k = out + re.escape(glob[k]), k + 1
    return out


def query_of(given: str | None, stream=None) -> str | None:
    """A query as given, or what is piped in for ``-`` and for none; None where nobody pipes anything."""
    if given is not None and given != "-":
        return given
    stream = stream or sys.stdin
    if stream.isatty():
        return None
    try:
        piped = stream.read().strip()
    except OSError as e:
        raise InputOutput(f"failed to read from stdin: {e}") from e
    if not piped:
        raise InvalidInput("query must not be empty", "give a query, or pipe one via stdin")
    return piped
