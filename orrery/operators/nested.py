"""Deeply nested records to related flat tables that keep parent-child links.

shred() opens every record once, in Arrow batches, and gives each object, list entry and record a row with the surrogate key of its parent and its ordinal.
merged_schema() says over all records which array levels there are, what members they have and of which types. child() is the table of one such level, with typed
columns by that schema; a single object or value in place of a list is a list of one there.

It is done by a walk and not by nested explode() calls as the levels recur in each other: the paths of a schema are far more than its levels, and grow with the records.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.sources.tables import whole_number

NODES = (
    "rec_id bigint, kind string, path string, parent_path string, field string, key string, ordinal bigint, depth int, id bigint, owner_id bigint, above_id bigint, owner_depth int, value string, members map<string,string>"
)
_ARROW = (pa.int64(), *[pa.string()] * 5, pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()))
_NAMES = [c.strip().split(" ")[0] for c in NODES.split(", ")]
_MARKS = re.compile(r"^[^A-Za-z0-9]+")
_WHOLE = re.compile(r"\s*([+-]?\d{1,32})(?:\.\d*)?\s*$")
#: Names of array levels and members that a merged schema may have; more are taken for data in the place of names and raise.
MOST_NAMES = 100_000


class _Number(str):
    """The text of a JSON number."""

    __slots__ = ()


def _no(x: str):
    raise ValueError(x)


def _load(text: str):
    """What a JSON text holds, objects as lists of all their (key, value) pairs in a _Pairs; numbers keep their text. ValueError if it is none."""
    try:
        return json.loads(text, object_pairs_hook=_Pairs, parse_int=_Number, parse_float=_Number, parse_constant=_no)
    except RecursionError:
        raise ValueError("too deep") from None


class _Pairs(list):
    __slots__ = ()


def _opened(v):
    """A value, or what its text holds where that is the text of an object or a list."""
    if type(v) is str and v.lstrip()[:1] in ("{", "["):
        try:
            return _load(v)
        except ValueError:
            return v
    return v


def _text(v) -> str | None:
    if v is None or type(v) is _Number:
        return v if v is None else str(v)
    if v is True or v is False:
        return "true" if v else "false"
    return v if v.isascii() else v.encode("utf-8", "replace").decode()


def _plain(v):
    return {k: _plain(x) for k, x in v} if isinstance(v, _Pairs) else [_plain(x) for x in v] if isinstance(v, list) else _text(v)


def _whole(v) -> int | None:
    """The whole number that a member spells, within 64 bits; a fraction is cut off."""
    if type(v) is _Number or type(v) is str:
        m = _WHOLE.match(v)
        if m:
            n = int(m[1])
            return n if -(2**63) <= n < 2**63 else None
    return None


_BARE: dict[str, str] = {}


def _bare(key: str) -> str:
    """A key without the marks before its first letter or digit."""
    got = _BARE.get(key)
    if got is None:
        if len(_BARE) > 100_000:
            _BARE.clear()
        got = _BARE[key] = _MARKS.sub("", key)
    return got


def _walk(rec_id, top: _Pairs, skip: frozenset[str], wanted: frozenset[str] | None) -> Iterator[tuple]:
    """Rows of one record. A stack and no recursion, so depth costs nothing here."""
    # value, kind, path, parent_path, field, key, ordinal, depth, id of the object that holds it, id above that, its depth
    stack = [(top, "$", None, None, None, 0, 0, None, None, -1)]
    while stack:
        v, path, parent, field, key, ordinal, depth, owner, above, owner_depth = stack.pop()
        if not isinstance(v, _Pairs):
            if isinstance(v, list):
                if wanted is None:
                    yield (rec_id, "list", path, parent, field, key, ordinal, depth, None, owner, above, owner_depth, None, None)
                inner = (field or "") + "[]"
                stack += [(_opened(x), f"{path}/{k}", path, inner, None, k, depth + 1, owner, above, owner_depth) for k, x in enumerate(v)]
            elif wanted is None or field in wanted:
                yield (rec_id, "entry", path, parent, field, key, ordinal, depth, None, owner, above, owner_depth, _text(v), None)
            continue
        own, members, below, seen, plain = None, {}, [], {}, False
        for place, (k, x) in enumerate(v):
            bare = _bare(k)
            if type(x) is str:
                x = _opened(x)
            at = seen[k] = seen.get(k, 0) + 1
            step = k if at == 1 else f"{k}#{at}"
            if bare in skip:
                if wanted is not None:
                    plain = True
                    continue
                members.setdefault(bare, json.dumps(_plain(x), ensure_ascii=True) if isinstance(x, list) else _text(x))
            elif isinstance(x, list):
                below.append((x, step, bare, place))
            else:
                if bare == "id" and own is None:
                    own = _whole(x)
                if wanted is not None and field not in wanted and bare not in wanted:
                    plain = True
                    continue
                name, n = bare, 1
                while name in members:
                    n += 1
                    name = f"{bare}#{n}"
                members[name] = _text(x)
        if wanted is None or field in wanted or not wanted.isdisjoint(members):
            yield (rec_id, "object", path, parent, field, key, ordinal, depth, own, owner, above, owner_depth, None, [(a, _s(b)) for a, b in members.items()])
        # The nearest enclosing object with an id, for what is below this one; and for this one's own levels what stands above it.
        up = owner if owner is not None else above
        # An object of nothing but objects stands in place of a list: its members are entries of the level, under their keys.
        keyed = bool(below) and not members and not plain and field is not None and all(isinstance(x, _Pairs) for x, *_ in below)
        for x, step, bare, place in below:
            f, k = (field, step) if keyed else (bare, None)
            if isinstance(x, _Pairs):
                stack.append((x, f"{path}/{step}", path, f, k, place if keyed else 0, depth + 1, own, up, depth))
            else:
                stack += [(_opened(y), f"{path}/{step}/{j}", path, f, k, j, depth + 1, own, up, depth) for j, y in enumerate(x)]


def _s(v: str | None) -> str | None:
    return v if v is None or v.isascii() else v.encode("utf-8", "replace").decode()


def shred(records: DataFrame, key: str = "rec_id", payload: str = "payload", skip: tuple[str, ...] = ("tags",), levels: tuple[str, ...] | None = None) -> DataFrame:
    """Everything in all records, as flat rows; see NODES.

    records: one row per key with a JSON text. kind is 'object', 'list' (a list directly within a list), 'entry' (a value or null in a list), 'empty' (a null, empty or
    blank payload) or 'unreadable' (no JSON text of an object: so each record has a row). path is the surrogate key within the record ('$' is the record's
    object), parent_path that of the enclosing object or list; field the name of the array level, that is of the member that holds the row; ordinal its place
    there from 0. id is the object's own, owner_id that of the object that holds the level (owner_depth its depth, 0 for the top), above_id that of the nearest object with an
    id around the owner. members are the values of an object's other members as text; of a repeated key all are kept, the further ones as name#2 and so on.

    Texts that hold lists or objects are opened. Members named in `skip` are not entered, but kept as JSON text. Keys count without leading marks. An object of nothing but
    objects stands in place of a list: its members have the level's name as field and their own as key. Rows with a null key go; no rows give no rows; further
    columns are ignored. Records deeper than the parser's stack (some thousand levels) count as unreadable. With `levels` only rows of these levels, and objects that have
    them as members, come out, and no others are built.
    """
    skipped, wanted = frozenset(skip), frozenset(levels) if levels is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)], names=_NAMES)
        for b in batches:
            for rec_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                top = kind = None
                if text is None or not text.strip():
                    kind = "empty"
                else:
                    try:
                        top = _load(text)
                    except ValueError:
                        pass
                if isinstance(top, _Pairs):
                    rows.extend(_walk(rec_id, top, skipped, wanted))
                elif wanted is None:
                    rows.append((rec_id, kind or "unreadable", "$", None, None, None, 0, 0, None, None, None, -1, None, None))
                if len(rows) > 20_000:
                    yield pack()
                    rows = []
        if rows:
            yield pack()

    return records.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("rec_id"), F.col(payload).alias("payload")).mapInArrow(run, NODES)


def merged_schema(nodes: DataFrame) -> DataFrame:
    """(field, member, type, n, of, optional): over all records the members of the objects of each array level (null: the records themselves) and what is stored in them.

    member is null for the level itself: its type is 'object', 'entry', 'list' or several of these. Else type is the narrowest of bigint, double, boolean and string that holds
    all values, n the objects that have the member, of all objects of the level, and optional says whether some lack it. No records give no rows.
    """
    real = nodes.where("kind IN ('object', 'list', 'entry')")
    levels = real.groupBy("field").agg(F.concat_ws("|", F.sort_array(F.collect_set("kind"))).alias("type"), F.count("*").alias("n"), F.sum((F.col("kind") == "object").cast("bigint")).alias("of"))
    m = real.where("kind = 'object'").select("field", F.explode("members").alias("member", "value"))
    some = F.col("value").isNotNull()
    m = m.groupBy("field", "member").agg(
        F.count("*").alias("n"), F.sum(some.cast("bigint")).alias("values"), F.bool_and(F.when(some, F.col("value").try_cast("bigint").isNotNull() & F.col("value").rlike(r"^\s*-?\d+\s*$"))).alias("whole"),
        F.bool_and(F.when(some, F.col("value").try_cast("double").isNotNull() & F.col("value").rlike(r"^\s*-?[\d.]"))).alias("real"), F.bool_and(F.when(some, F.col("value").isin("true", "false"))).alias("truth"),
    )
    m = m.withColumn("type", F.expr("CASE WHEN whole THEN 'bigint' WHEN real THEN 'double' WHEN truth THEN 'boolean' ELSE 'string' END"))
    m = m.join(levels.select(F.col("field").alias("level"), "of"), F.col("field").eqNullSafe(F.col("level"))).select("field", "member", "type", "n", "of", (F.col("n") < F.col("of")).alias("optional"))
    return levels.select("field", F.lit(None).cast("string").alias("member"), "type", "n", "of", F.lit(False).alias("optional")).unionByName(m)


def child(nodes: DataFrame, field: str | None, columns: dict[str, str] | None = None) -> DataFrame:
    """The table of one array level: (rec_id, path, parent_path, key, ordinal, depth, id, owner_id, above_id, owner_depth, value) and one typed column for each of `columns`
    ({member: type}), named by it; a name that clashes gets a _ before it. value is the text of an entry that is no object. Values that don't fit a type are null."""
    base = ["rec_id", "path", "parent_path", "key", "ordinal", "depth", "id", "owner_id", "above_id", "owner_depth", "value"]
    of = F.col("field") == field if field is not None else F.col("field").isNull()
    rows = nodes.where(of & F.col("kind").isin("object", "entry")).select(*base, "members")
    if field is not None:
        # A single value in the place of a list.
        one = nodes.where((F.col("kind") == "object") & F.map_contains_key("members", field)).withColumn("v", F.element_at("members", field)).where("v IS NOT NULL")
        rows = rows.unionByName(one.select(
            "rec_id", F.concat_ws("/", "path", F.lit(field)).alias("path"), F.col("path").alias("parent_path"), F.lit(None).cast("string").alias("key"), F.lit(0).cast("bigint").alias("ordinal"), (F.col("depth") + 1).alias("depth"),
            F.lit(None).cast("bigint").alias("id"), F.col("id").alias("owner_id"), F.coalesce("owner_id", "above_id").alias("above_id"), F.col("depth").alias("owner_depth"), F.col("v").alias("value"), F.lit(None).cast("map<string,string>").alias("members"),
        ))
    typed = [(whole_number(x) if t == "bigint" else x.try_cast(t)).alias("_" + m if m in base else m) for m, t in (columns or {}).items() for x in [F.element_at("members", m)]]
    return rows.select(*base, *typed)


def tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """One table for each array level of the merged schema, and 'records' for the objects at the top: {name: child()}. Shred once and materialize before."""
    schema = merged_schema(nodes).limit(MOST_NAMES + 1).collect()
    if len(schema) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names of members")
    levels: dict = {r["field"]: {} for r in schema if r["member"] is None}
    for r in sorted((r for r in schema if r["member"] is not None), key=lambda r: r["member"]):
        levels.setdefault(r["field"], {})[r["member"]] = r["type"]
    return {f if f is not None else "records": child(nodes, f, c) for f, c in levels.items()}


def references(nodes: DataFrame, level: str = "nd", ref: str = "ref") -> DataFrame:
    """(rec_id, parent_id, elem_id, path, pos, ref): one row for each reference in the `nd` of an object below the top with an id.

    pos is the place in nd from 0, entries without a reference counted; an nd that is no list is one entry at 0.
    A reference is the `ref` of an entry or the entry itself when it is a bare id.
    """
    e = child(nodes, level, {ref: "bigint"}).where("owner_depth > 0 AND owner_id IS NOT NULL AND key IS NULL")
    value = F.coalesce(F.col(ref), whole_number(F.col("value")))
    return e.select("rec_id", F.col("above_id").alias("parent_id"), F.col("owner_id").alias("elem_id"), F.col("parent_path").alias("path"), F.col("ordinal").alias("pos"), value.alias("ref")).where("ref IS NOT NULL")
