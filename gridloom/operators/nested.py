"""Deeply nested records turned into flat tables that keep their parents.

Columnar shredding: every leaf path of a record becomes a column of
``(repetition level, definition level, value)`` triples. The repetition level
says at which repeated ancestor a value starts anew, the definition level how
many steps of its path exist. Tables are then rebuilt per repeated ancestor from
these level sequences alone: counting repetitions gives each entry the ordinal
of every repeated ancestor, by which columns of one ancestor are put together.

Records are read whole, one at a time, in Arrow batches; there is no shuffle, so
a hot feed is no matter, and no group is gathered.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The step of a path into the entries of a list.
REPEATED = "[]"

Column = list[tuple[int, int, str | None]]
_LARGEST = 2**63 - 1


class _Text(str):
    """A number or boolean as it is written."""


def read_json(payload: str | None) -> object | None:
    """The parsed record with numbers as written; None if it is not complete.
    A byte order mark before it is no part of it."""
    if payload is None:
        return None
    text = payload.lstrip("\ufeff")
    try:
        return json.loads(text, parse_int=_Text, parse_float=_Text, parse_constant=_Text)
    except RecursionError:
        try:
            return _read_deep(text)
        except (ValueError, LookupError):
            return None
    except ValueError:
        return None


_BLANK = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity")
_WORDS = {"true": True, "false": False, "null": None}


def _read_deep(text: str) -> object:
    """As the library's reader, for nesting that its recursion cannot take."""
    skip = lambda i: _BLANK.match(text, i).end()

    def name(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError("a name was expected")
        k, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("a colon was expected")
        return k, skip(i + 1)

    opened: list[tuple[dict | list, str | None]] = []
    key, i = None, skip(0)
    while True:
        c = text[i : i + 1]
        if c in ("{", "["):
            box: dict | list = {} if c == "{" else []
            i = skip(i + 1)
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                opened.append((box, key))
                if c == "{":
                    key, i = name(i)
                continue
            value, i = box, i + 1
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        else:
            m = _SCALAR.match(text, i)
            if m is None:
                raise ValueError("a value was expected")
            value, i = _WORDS.get(m[0], _Text(m[0])), m.end()
        while True:  # put the value where it belongs, close what ends here
            i = skip(i)
            if not opened:
                if i != len(text):
                    raise ValueError("more text after the record")
                return value
            box, outer = opened[-1]
            if isinstance(box, dict):
                box[key] = value
            else:
                box.append(value)
            c = text[i : i + 1]
            if c == ",":
                i = skip(i + 1)
                if isinstance(box, dict):
                    key, i = name(i)
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("a container does not end")
            opened.pop()
            value, key, i = box, outer, i + 1


class Step:
    """A step of the paths of a record: a field name or ``REPEATED``. Steps are
    shared by all paths through them, so depth costs no more than its steps."""

    __slots__ = ("above", "name", "below", "depth", "repeats", "leaf")

    def __init__(self, above: Step | None, name: str):
        self.above, self.name, self.leaf = above, name, False
        self.below: dict[str, Step] = {}
        self.depth = above.depth + 1 if above else 0
        self.repeats = (above.repeats if above else 0) + (name == REPEATED)

    def to(self, name: str) -> Step:
        return self.below.get(name) or self.below.setdefault(name, Step(self, name))

    @property
    def path(self) -> tuple[str, ...]:
        out, s = [], self
        while s.above:
            out.append(s.name)
            s = s.above
        return tuple(reversed(out))

    def columns(self) -> Iterator[Step]:
        """The leaf steps at and under this one."""
        stack = [self]
        while stack:
            s = stack.pop()
            if s.leaf:
                yield s
            stack.extend(s.below.values())


def _fields(node: dict) -> dict[str, object]:
    """An object's fields; one that is named like ``REPEATED`` is told apart."""
    return {(f"{k} " if k == REPEATED else k): v for k, v in node.items()} if REPEATED in node else node


def _paths(record: object) -> Step:
    """All paths of a record."""
    root = Step(None, "")
    stack = [(record, root)]
    while stack:
        node, step = stack.pop()
        if isinstance(node, dict) and node:
            stack.extend((v, step.to(k)) for k, v in _fields(node).items())
        elif isinstance(node, list) and node:
            entry = step.to(REPEATED)
            stack.extend((v, entry) for v in node)
        else:
            step.leaf = True
    return root


def shred(record: object) -> dict[Step, Column]:
    """Level columns of every leaf path of a record, of any depth.

    A list repeats; an object defines its fields; a scalar is a leaf; null, an
    empty list and an empty object are leaves without a value, whose definition
    level tells how far the path existed. Where a path is absent each of its
    columns gets an undefined entry, so that every column has an entry for every
    instance of its nearest ancestor.
    """
    root = _paths(record)
    out: dict[Step, Column] = {s: [] for s in root.columns()}
    stack = [(record, root, 0, 0)]
    while stack:
        node, step, r, d = stack.pop()
        has: dict[str, object] = _fields(node) if isinstance(node, dict) else {}
        if isinstance(node, list) and node:
            entry = step.below[REPEATED]
            stack.extend((v, entry, entry.repeats, d + 1) for v in reversed(node[1:]))
            stack.append((node[0], entry, r, d + 1))
            gone = [s for s in step.below.values() if s is not entry]
        else:
            stack.extend((v, step.below[k], r, d + 1) for k, v in has.items())
            gone = [s for k, s in step.below.items() if k not in has]
        if step.leaf:
            text = node if isinstance(node, str) else "true" if node is True else "false" if node is False else None
            out[step].append((r, d + 1, str(text)) if text is not None else (r, d, None))
        undefined = (r, d, None)
        for s in gone:
            for c in s.columns():
                out[c].append(undefined)
    return out


class Instances:
    """Every instance of a repeated ancestor: its own ancestor's and its ordinal."""

    def __init__(self):
        self.of: dict[tuple[Step, int, int], int] = {}
        self.up: list[tuple[int, int]] = []

    def get(self, step: Step, above: int, ordinal: int) -> int:
        key = (step, above, ordinal)
        at = self.of.get(key)
        if at is None:
            at = self.of[key] = len(self.up)
            self.up.append((above, ordinal))
        return at

    def ordinals(self, at: int) -> tuple[int, ...]:
        out = []
        while at >= 0:
            at, ordinal = self.up[at]
            out.append(ordinal)
        return tuple(reversed(out))


def by_ancestor(columns: dict[Step, Column]) -> tuple[dict[Step | None, dict[int, dict[tuple[str, ...], str]]], Instances]:
    """Tables per repeated ancestor: ancestor -> instance -> the values of the
    leaves between it and the next repeated step, by relative path. None and -1
    stand for the record itself.

    Instances come from the levels alone: repetition level k counts up the k-th
    ancestor and starts those within it anew; the definition level says how many
    of them there are.
    """
    tables: dict[Step | None, dict[int, dict[tuple[str, ...], str]]] = {}
    made = Instances()
    for leaf, column in columns.items():
        chain: list[Step] = []
        rest: list[str] = []
        s = leaf
        while s.above:
            if s.name == REPEATED:
                chain.append(s)
            elif not chain:
                rest.append(s.name)
            s = s.above
        chain.reverse()
        relative = tuple(reversed(rest))
        rows = tables.setdefault(chain[-1] if chain else None, {})
        count: list[int] = []
        at: list[int] = []
        for r, d, v in column:
            if r:
                del count[r:], at[r - 1 :]
                count[r - 1] += 1
                at.append(made.get(chain[r - 1], at[r - 2] if r > 1 else -1, count[r - 1]))
            else:
                count, at = [], []
            while len(at) < len(chain) and chain[len(at)].depth <= d:
                at.append(made.get(chain[len(at)], at[-1] if at else -1, 0))
                count.append(0)
            if v is not None:
                rows.setdefault(at[-1] if at else -1, {})[relative] = v
    return tables, made


# -- elements of the feeds -----------------------------------------------------

KINDS = ("node", "way", "relation")


def _listed(v: object) -> list:
    return v if isinstance(v, list) else [v]


def _as_lists(element: dict) -> dict:
    """One shape for the feeds' variants, before shredding, of an element and of
    the members that are elements again.

    Single objects and scalars where a list belongs become lists of one; tags
    become lists of ``{k, v}``; node entries become ``{ref}``.
    """
    top: list = [element]
    stack: list[tuple[list, int]] = [(top, 0)]
    while stack:
        home, i = stack.pop()
        node = home[i]
        if isinstance(node, list):
            home[i] = list(node)
            stack.extend((home[i], k) for k in range(len(node)))
        elif isinstance(node, dict):
            out = home[i] = dict(node)
            if "tags" in out:
                out["tags"] = _tag_list(out["tags"])
            if out.get("nodes") is not None:
                out["nodes"] = [x if isinstance(x, dict) else {"ref": x} for x in _listed(out["nodes"])]
            if out.get("members") is not None:
                out["members"] = list(_listed(out["members"]))
                stack.extend((out["members"], k) for k in range(len(out["members"])))
    return top[0]


def _tag_list(v: object) -> object:
    if isinstance(v, dict):
        if set(v) == {"k", "v"}:
            return [v]
        return [{"k": k, "v": x} for k, x in v.items()]
    return v


def _elements(record: object) -> list[dict]:
    """The top elements of a record, wherever its wrappers hold them; containers
    named after a kind give their elements that type."""
    out: list[dict] = []
    stack: list[tuple[object, str | None]] = [(record, None)]
    while stack:
        node, kind = stack.pop()
        if kind is not None:
            if isinstance(node, dict):
                out.append(_as_lists({"type": kind, **node}))
        elif isinstance(node, list):
            stack.extend((x, None) for x in reversed(node))
        elif isinstance(node, dict):
            if str(node.get("type")) in KINDS and ("id" in node or "ref" in node):
                out.append(_as_lists(node))
            else:
                parts = [(x, k) for k, v in node.items() for x in (_listed(v) if k in KINDS else [v])]
                stack.extend((x, k if k in KINDS else None) for x, k in reversed(parts))
    return out


def element_children(payload: str | None) -> list[tuple]:
    """``(parent_type, parent_id, kind, pos, name, item)`` of each tag, node and
    member of each element of a payload, at any depth, distinct, in order.
    Children of a parent whose id is no whole number of 64 bits are left out."""
    record = read_json(payload)
    if record is None:
        return []
    tables, made = by_ancestor(shred(_elements(record)))
    rows: dict[tuple, None] = {}

    def parent(element: Step | None, at: int) -> tuple[str, int] | None:
        own = tables.get(element, {}).get(at, {})
        kind = own.get(("type",))
        ref = own.get(("id",)) if own.get(("id",)) is not None else own.get(("ref",))
        try:
            number = int(str(ref).removesuffix(".0"))
        except ValueError:
            return None
        return (kind, number) if kind is not None and -_LARGEST - 1 <= number <= _LARGEST else None

    for step, entries in tables.items():
        what = step.above.name if step and step.above else None
        element = step.above.above if what in ("tags", "nodes", "members") else None
        if element is None or element.name != REPEATED:
            continue
        for at, leaf in entries.items():
            above, pos = made.up[at]
            p = parent(element, above)
            if p is None:
                continue
            if what == "tags":
                if ("k",) in leaf and ("v",) in leaf:
                    rows[(*p, "tag", 0, leaf[("k",)], leaf[("v",)])] = None
            elif what == "nodes":
                item = leaf.get(("ref",), leaf.get(("id",)))
                if item is not None:
                    rows[(*p, "node", pos, "", item)] = None
            elif ("type",) in leaf:
                ref = leaf.get(("ref",), leaf.get(("id",)))
                if ref is not None:
                    rows[(*p, "member", pos, leaf.get(("role",), ""), f"{leaf[('type',)]}/{ref}")] = None
    return list(rows)


def flat_children(df: DataFrame, id_col: str = "rec_id", payload_col: str = "payload") -> DataFrame:
    """One flat row per tag, node and member, naming its parent.

    A payload that cannot be read whole, is null or empty gives no rows, and so
    do children of a parent without type or id. Rows are distinct per record; a
    null record id stays null. Other columns are not read.
    """
    schema = pa.schema(
        [
            ("rec_id", pa.int64()), ("parent_type", pa.string()), ("parent_id", pa.int64()), ("kind", pa.string()),
            ("pos", pa.int64()), ("name", pa.string()), ("item", pa.string()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            for rec, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in element_children(payload):
                    for c, v in zip(cols, (rec, *row)):
                        c.append(v)
                if len(cols[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
                    cols = [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    slim = df.select(F.col(id_col).cast("bigint").alias("r"), F.col(payload_col).cast("string").alias("p"))
    out = slim.mapInArrow(run, "rec_id bigint, parent_type string, parent_id bigint, kind string, pos bigint, name string, item string")
    return out if id_col == "rec_id" else out.withColumnRenamed("rec_id", id_col)
