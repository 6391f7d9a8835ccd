"""Where files come from: patterns, order, and one schema for all of them."""

from __future__ import annotations

import glob as _glob
import os
import re

from avrolith.container import filesystem, open_file, read_header
from avrolith.errors import ConfigurationError, SchemaError, SourceNotFoundError
from avrolith.schema import Schema, as_record, parse_schema, to_json

_MAGIC = re.compile(r"[*?\[\]{}]")


def is_glob(path: str) -> bool:
    return _MAGIC.search(path) is not None


def expand_braces(pattern: str) -> list[str]:
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        return [pattern]
    return list(dict.fromkeys(x for part in m[1].split(",") for x in expand_braces(pattern[: m.start()] + part + pattern[m.end() :])))


def _to_regex(pattern: str) -> re.Pattern:
    def part(text: str) -> str:
        return re.escape(text).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")

    out, at = "", 0
    for m in re.finditer(r"\[(!?)(\]?[^\]]*)\]", pattern):  # one of some characters
        inner = m[2].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("^", "\\^")
        out += part(pattern[at : m.start()]) + (f"[^/{inner}]" if m[1] else f"[{inner}]")
        at = m.end()
    return re.compile(out + part(pattern[at:]))


def expand_glob(pattern: str, options: dict | None = None) -> list[str]:
    """Sorted files of a pattern with * ? [ ] { } and **; none is an error."""
    found: set[str] = set()
    for one in expand_braces(pattern):
        if "://" in one and not one.startswith("file:"):
            from pyarrow import fs

            scheme, rest = one.split("://", 1)
            base = (rest[: _MAGIC.search(rest).start()] if _MAGIC.search(rest) else rest).rpartition("/")[0]
            files, root = filesystem(f"{scheme}://{base}", options)
            root = root.rstrip("/")  # what the store calls the folder: a URI may hold a host as well
            match = _to_regex(rest[len(base) :])
            listed = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
            found |= {f"{scheme}://{base}{i.path[len(root) :]}" for i in listed if i.type == fs.FileType.File and match.fullmatch(i.path[len(root) :])}
        else:
            local = re.sub("^file:(//)?", "", one)
            found |= {p for p in _glob.glob(local, recursive=True, include_hidden=True) if os.path.isfile(p)}
    if not found:
        raise SourceNotFoundError(f"no file matches {pattern!r}")
    return sorted(found)


def paths_of(source, glob: bool = True, options: dict | None = None) -> list[str]:
    """The files of a str, Path or sequence of these, in the given order, each once."""
    if isinstance(source, (str, os.PathLike)):
        source = [source]
    try:
        items = list(source)
    except TypeError:
        raise TypeError(f"a source is a path or a sequence of paths, not {type(source).__name__}") from None
    if not items:
        raise ConfigurationError("no source given")
    out: dict[str, None] = {}
    for item in items:
        if not isinstance(item, (str, os.PathLike)):
            raise TypeError(f"a path is str or Path, not {type(item).__name__}")
        path = os.fspath(item)
        for p in expand_glob(path, options) if glob and is_glob(path) else [path]:
            out.setdefault(p)
    return list(out)


def header_of(path: str, options: dict | None = None):
    with open_file(path, options) as file:
        return read_header(file, path)


def schema_of(header) -> Schema:
    return as_record(parse_schema(header.schema_json))


def unify(schemas: list[tuple[str, Schema]]) -> Schema:
    """The first file's schema, if all others have its name, fields and types in any order."""
    (_, first), known = schemas[0], {}
    want = {f.name: f.schema for f in first.fields}
    for path, s in schemas[1:]:
        text = str(to_json(s))
        if text in known:
            continue
        known[text] = True
        if s.name != first.name:
            raise SchemaError(f"{path}: record {s.name!r}, not {first.name!r}")
        have = {f.name: f.schema for f in s.fields}
        if have.keys() != want.keys():
            raise SchemaError(f"{path}: fields differ by {sorted(have.keys() ^ want.keys())}")
        for name, t in have.items():
            if to_json(t) != to_json(want[name]):
                raise SchemaError(f"{path}: field {name!r} has another type")
    return first


def pick_columns(record: Schema, columns) -> list[str] | None:
    """Names, in schema order, of columns given by name or index."""
    if columns is None:
        return None
    names = [f.name for f in record.fields]
    picked = set()
    for c in columns:
        if isinstance(c, int) and not isinstance(c, bool):
            if not 0 <= c < len(names):
                raise SchemaError(f"column index {c} is out of range; there are {len(names)} columns")
            picked.add(names[c])
        elif c in names:
            picked.add(c)
        else:
            raise SchemaError(f"unknown column {c!r}; available: {names}")
    return [n for n in names if n in picked]
