"""Deeply nested records to related flat tables (problem 6).

Each JSON text is read once by a loop with an explicit stack (no recursion, so any depth is safe) that emits path-value-ordinal triples. Every
value belongs to its nearest repeated ancestor: the root, or an object in an array. The path of the arrays names the ancestor's table, its number
counts the rows of that table in document order, the path of the triple is what lies between ancestor and value. Objects that are not
repeated only lengthen the path. Triples are grouped by ancestor and each group is pivoted into one table; a row keeps the number of its parent,
which is in the table named by the path without its last part.

``same`` names fields whose objects are rows of the table they are nested in (a tree), with or without an array around them; ``leaf`` names
fields that hold a map: their entries are values, whatever they hold, kept as JSON if they are no scalars.

Defined results
- A null text, a text that is not one valid JSON value, or a root that is no object gives no rows.
- ``children`` may be absent, null, empty, an array, or one object without its array; entries that are no objects are no rows.
- ``attrs`` that is absent, null, empty or no object gives no attributes; a key with a null value is an attribute with null value.
- Scalars in an array are triples whose path ends with []; an array in an array is one value, kept as JSON.
- If the key of a scalar is repeated in one object, the last one counts; rows of a repeated array key all count.
- Trees delivered several times count once; if different texts share an id, the smallest text counts.
- What no column of a pivot names is in its map ``others``, so no field is lost. A record's triples are held until its end, as
  a text cut off there gives none; so a task needs memory in proportion to its largest record and to ``SLICE`` triples.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE = 50_000

_WS = r"[ \t\n\r]*+"
_STRING = r'"((?:[^"\\\x00-\x1f]++|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+)"'
_VALUE = rf"(?:{_STRING}|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null)|([{{\[]))"
_MEMBER = re.compile(f"{_WS}{_STRING}{_WS}:{_WS}{_VALUE}")
_ELEMENT = re.compile(f"{_WS}(){_VALUE}")
_TAIL = re.compile(rf"{_WS}([,}}\]])")
_ROOT = re.compile(rf"{_WS}\{{")
_SPACE = re.compile(_WS)
_ESCAPE = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.")
_PLAIN = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}

#: What happens with the members of a container: they are read, they are the values of a map, they are skipped, or they are rows of the same table.
_READ, _MAP, _SKIP, _ROWS = range(4)


def _unescape(m: re.Match) -> str:
    s = m.group()
    if len(s) == 12:
        return chr(0x10000 + ((int(s[2:6], 16) - 0xD800) << 10) + int(s[8:12], 16) - 0xDC00)
    if len(s) == 6:
        code = int(s[2:], 16)
        return "�" if 0xD800 <= code < 0xE000 else chr(code)
    return _PLAIN.get(s[1], s[1])


def nested_triples(text: str, same: Sequence[str] = (), leaf: Sequence[str] = ()) -> list[tuple[str, int, int, str, str | None]] | None:
    """(table, row number, parent's number, path, value); a row itself has the path ''. None if not one valid JSON object."""
    m = _ROOT.match(text)
    if m is None:
        return None
    out: list[tuple[str, int, int, str, str | None]] = [("", 0, -1, "", None)]
    numbers = {"": 1}
    member, element, tail, add = _MEMBER.match, _ELEMENT.match, _TAIL.match, out.append
    #: (is an object, table, row, path, what to do with the members, table of rows in it, (path, start) of a value kept as JSON)
    frame = (True, "", 0, "", _READ, "", None)
    stack: list[tuple] = []
    pos, fresh = m.end(), True
    while True:
        is_object, table, row, path, mode, inner, _ = frame
        m = member(text, pos) if is_object else element(text, pos)
        if m is None:
            m = tail(text, pos) if fresh else None
            if m is None or m[1] == ",":
                return None
        else:
            fresh, kind = False, m.lastindex
            key = m[1]
            if mode != _SKIP:
                if is_object:
                    if "\\" in key:
                        key = _ESCAPE.sub(_unescape, key)
                    here = path + key
                else:
                    here = path + "[]"
            if kind == 5:
                opened = m[5] == "{"
                pos, start, fresh = m.end(), m.start(5), True
                stack.append(frame)
                if mode == _SKIP:
                    frame = (opened, table, row, "", _SKIP, "", None)
                    continue
                into = None
                if not is_object and opened:
                    into = inner
                elif is_object and mode == _READ and not path and key in same:
                    if not opened:
                        frame = (False, table, row, here, _ROWS, table, None)
                        continue
                    into = table
                if into is not None:
                    number = numbers.get(into, 0)
                    numbers[into] = number + 1
                    add((into, number, row, "", None))
                    frame = (True, into, number, "", _READ, "", None)
                elif not is_object or mode == _MAP or (not opened and not path and key in leaf):
                    frame = (opened, table, row, "", _SKIP, "", (here, start))
                elif opened:
                    frame = (True, table, row, here + ".", _MAP if not path and key in leaf else _READ, "", None)
                else:
                    frame = (False, table, row, here, _READ, f"{table}/{here}", None)
                continue
            pos = m.end()
            if mode != _SKIP:
                value = m[kind]
                if kind == 2:
                    if "\\" in value:
                        value = _ESCAPE.sub(_unescape, value)
                elif value == "null":
                    value = None
                add((table, row, -1, here, value))
            m = tail(text, pos)
        while True:
            if m is None:
                return None
            pos = m.end()
            mark = m[1]
            if mark == ",":
                break
            if (mark == "}") != frame[0]:
                return None
            if frame[6] is not None:
                add((frame[1], frame[2], -1, frame[6][0], text[frame[6][1] : pos]))
            if not stack:
                return out if _SPACE.match(text, pos).end() == len(text) else None
            frame = stack.pop()
            m = tail(text, pos)
        fresh = False


def triples(text: str | None) -> list[tuple[int, int, str, str | None]]:
    """(node number, parent number, path within the node, value) of a tree of ``children`` with ``attrs``. Empty if not valid."""
    got = nested_triples(text, ("children",), ("attrs",)) if text is not None else None
    return [x[1:] for x in got or () if x[0] == ""]


def record_triples(df: DataFrame, key: str, text: str, same: Sequence[str] = ("children",), leaf: Sequence[str] = ("attrs",)) -> DataFrame:
    """``__key``, ``table``, ``node_no``, ``parent_no`` (-1 but for the row's own triple), ``path``, ``value``, ``ordinal`` of every record.

    ``ordinal`` counts the triples of a record, so the last one of a repeated key can be told.
    """
    one = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).groupBy("__key").agg(F.min("__text").alias("__text"))
    kind = one.schema["__key"].dataType.simpleString()
    same, leaf = frozenset(same), frozenset(leaf)
    names = ["__key", "table", "node_no", "parent_no", "path", "value", "ordinal"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(keys: pa.Array) -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(owner, pa.int32())), *columns, pa.array(ordinal, pa.int64())], names)

        for batch in batches:
            rows, owner, ordinal = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                got = nested_triples(t, same, leaf)
                if got:
                    rows += got
                    owner += [i] * len(got)
                    ordinal += range(len(got))
                if len(rows) > SLICE:
                    yield part(batch.column(0))
                    rows, owner, ordinal = [], [], []
            yield part(batch.column(0))

    return one.filter("__text is not null").mapInArrow(run, f"__key {kind}, table string, node_no bigint, parent_no bigint, path string, value string, ordinal bigint")


def pivoted(t: DataFrame, key: str, table: str, columns: Mapping[str, str], maps: Mapping[str, str], others: str | None = "others") -> DataFrame:
    """One row per repeated ancestor of ``table``: ``key``, ``node_no``, ``parent_no``, a column for each path of ``columns``, a map for each prefix of
    ``maps`` (what follows the prefix to the value), and ``others``: a map of all other paths."""
    rows = t.filter(F.col("table") == table)
    path = F.col("path")

    def entries(condition: Column, name: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(condition, F.struct(name.alias("k"), F.col("ordinal").alias("o"), F.col("value").alias("v")))))

    aggregates = [F.max(F.when(path == "", F.col("parent_no"))).alias("parent_no")]
    aggregates += [F.max_by("value", F.when(path == p, F.col("ordinal"))).alias(name) for name, p in columns.items()]
    aggregates += [entries(path.startswith(p), F.substr(path, F.lit(len(p) + 1))).alias(name) for name, p in maps.items()]
    if others:
        rest = (path != "") & ~path.isin(*columns.values())
        for p in maps.values():
            rest = rest & ~path.startswith(p)
        aggregates.append(entries(rest, path).alias(others))
    grouped = rows.groupBy("__key", "node_no").agg(*aggregates)

    def last(name: str) -> Column:
        pairs = F.col(name)
        kept = F.filter(pairs, lambda x, i: (i == F.size(pairs) - 1) | (F.get(pairs, i + 1)["k"] != x["k"]))
        return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["k"], x["v"]))).alias(name)

    return grouped.select(F.col("__key").alias(key), "node_no", "parent_no", *columns, *map(last, [*maps, *([others] if others else [])]))


def flat_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per node: ``key``, ``node_no``, ``parent_no``, ``tag``, ``text``, ``attrs`` and ``others`` (maps from key to value).

    The node table is this without the maps; the attribute table is its ``explode(attrs)``. Both link to the parent by (key, parent_no).
    """
    return pivoted(record_triples(df, key, text), key, "", {"tag": "tag", "text": "text"}, {"attrs": "attrs."})


def node_attribute_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``node_no``, ``parent_no``, ``tag``, ``attr``: one row with attr '' per node and one per attribute key."""
    flat = pivoted(record_triples(df, key, text), key, "", {"tag": "tag"}, {"attrs": "attrs."}, None)
    names = F.concat(F.array(F.lit("")), F.map_keys("attrs"))
    return flat.select(key, "node_no", "parent_no", "tag", F.explode(names).alias("attr"))
