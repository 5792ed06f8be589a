"""Nested records, orphan references and spatial joins on small and dirty inputs."""

import json
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from orrery.operators import nested, orphans, spatial
from orrery.sources.tables import in_force, place_columns, places, whole_number


def test_in_force_takes_the_latest_row(spark, rows):
    d = spark.createDataFrame([(1, "a", datetime(2020, 1, 1)), (1, None, datetime(2021, 1, 1)), (2, "c", None), (None, "d", datetime(2020, 1, 1)), (3, "e", datetime(2020, 1, 1)), (3, "e", datetime(2020, 1, 1))], "id long, v string, loaded_at timestamp_ntz")
    assert [r[:2] for r in rows(in_force(d, "id").select("id", "v"))] == [(1, None), (2, "c"), (3, "e")]
    assert in_force(d.limit(0), "id").count() == 0


def test_whole_number_and_places(spark, rows):
    d = spark.createDataFrame([(" 0012 ",), ("7.0",), ("x",), (None,), ("",)], "id string")
    assert [r[0] for r in d.select(whole_number(F.col("id"))).collect()] == [12, 7, None, None, None]
    g = [("1", 10.0, 20.0, None, 4326), ("2", 0.0, 0.0, (5.0, 6.0), 4326), ("3", float("nan"), 1.0, (1113194.9079327357, 0.0), 3857), ("4", 200.0, 1.0, None, None), ("5", None, 1.0, (0.0, 0.0), 4326), ("6", None, None, (1.0, 2.0), 9999), ("7", None, None, (float("inf"), 2.0), 4326)]
    d = spark.createDataFrame([(i, lon, lat, xy, s, datetime(2020, 1, 1)) for i, lon, lat, xy, s in g], "id string, lon double, lat double, geometry struct<x:double,y:double>, srid int, loaded_at timestamp_ntz")
    got = {r[0]: (round(r[1], 6), round(r[2], 6)) for r in places(d).collect()}
    assert got == {1: (10.0, 20.0), 2: (5.0, 6.0), 3: (10.0, 0.0)}
    assert places(d.limit(0)).count() == 0


PAYLOADS = {
    1: {"id": 10, "elements": [{"id": "11", "nd": [{"ref": 1}, None, {"ref": "2"}, {"note": "x"}, "3", 4]}, {"@id": 12, "nd": {"_ref": 5}, "inner": {"deep": [{"id": 13, "nd": 6}]}}]},
    2: {"elements": {"e0": {"id": 21, "nd": []}, "e1": {"_id": 22, "nd": json.dumps([{"@ref": 7}]), "tags": {"id": 99, "nd": [1]}}}, "nd": [1]},
    3: {"id": 30, "elements": json.dumps([{"id": 31, "nd": [{"ref": 8, "x": {"id": 32, "nd": ["9"]}}]}])},
    4: {"id": 40, "elements": [{"nd": [1]}, {"id": None, "nd": [1]}, {"id": 41, "nd": None}, {"id": "no", "nd": [1]}]},
}


def test_references_of_nested_elements(spark, rows):
    d = spark.createDataFrame([(k, json.dumps(v), 1) for k, v in PAYLOADS.items()] + [(5, "", 1), (6, None, 1), (7, '{"id":', 1), (8, "[1,2]", 1), (None, "{}", 1), (9, '{"id": 1}' + " " * 10000, 1)], "rec_id long, payload string, path int")
    got = rows(nested.references(nested.shred(d)).select("rec_id", "parent_id", "elem_id", "pos", "ref"))
    assert got == sorted([(1, 10, 11, 0, 1), (1, 10, 11, 2, 2), (1, 10, 11, 4, 3), (1, 10, 11, 5, 4), (1, 10, 12, 0, 5), (1, 12, 13, 0, 6), (2, None, 22, 0, 7), (3, 30, 31, 0, 8), (3, 31, 32, 0, 9)], key=str)
    assert rows(nested.references(nested.shred(d, levels=("nd",))).select("rec_id", "parent_id", "elem_id", "pos", "ref")) == got
    assert nested.references(nested.shred(d.limit(0))).count() == 0 and nested.merged_schema(nested.shred(d.limit(0))).count() == 0
    tree = nested.shred(d).collect()
    assert {(r["rec_id"], r["kind"]) for r in tree if r["rec_id"] in (5, 6, 7, 8)} == {(5, "empty"), (6, "empty"), (7, "unreadable"), (8, "unreadable")}
    one = [r for r in tree if r["rec_id"] == 1]
    assert len({r["path"] for r in one}) == len(one) and {r["parent_path"] for r in one} - {None} <= {r["path"] for r in one}
    # A repeated key, a number past 64 bits, a half of a surrogate pair, lists within lists.
    odd = spark.createDataFrame([(1, '{"id": 1, "e": [{"id": 2, "nd": [3], "nd": [4]}, {"id": 99999999999999999999, "nd": [5]}, {"id": 7, "nd": [[8], 9], "note": "\\ud800", "id": 70}]}')], "rec_id long, payload string")
    assert rows(nested.references(nested.shred(odd)).select("elem_id", "pos", "ref")) == [(2, 0, 3), (2, 0, 4), (7, 1, 9)]
    assert nested.shred(odd).where("members['id#2'] = '70'").count() == 1


def test_tables_by_the_merged_schema(spark, rows):
    d = spark.createDataFrame([(1, '{"id": 1, "sent": {"by": "x"}, "lines": [{"no": 1, "w": 1.5, "tags": {"a": 1}}, {"no": "2", "ok": true}, 7, null]}'), (2, '{"id": 2, "lines": 5}'), (3, '{"lines": {"no": 3, "path": "p"}}')], "rec_id long, payload string")
    n = nested.shred(d)
    schema = {(r["field"], r["member"]): (r["type"], r["n"], r["of"], r["optional"]) for r in nested.merged_schema(n).collect()}
    assert schema[None, "id"] == ("bigint", 2, 3, True) and schema["lines", "no"] == ("bigint", 3, 3, False) and schema["lines", "w"] == ("double", 1, 3, True) and schema["lines", "ok"] == ("boolean", 1, 3, True)
    assert schema["lines", None] == ("entry|object", 5, 3, False) and schema["sent", "by"] == ("string", 1, 1, False)
    t = nested.tables(n)
    assert set(t) == {"records", "sent", "lines"}
    got = sorted((r["rec_id"], r["ordinal"], r["owner_id"], r["value"], r["no"], r["w"], r["ok"], r["_path"]) for r in t["lines"].collect() if r["value"] is not None or r["no"])
    assert got == [(1, 0, 1, None, 1, 1.5, None, None), (1, 1, 1, None, 2, None, True, None), (1, 2, 1, "7", None, None, None, None), (2, 0, 2, "5", None, None, None, None), (3, 0, None, None, 3, None, None, "p")]
    assert t["lines"].where("tags = '{\"a\": \"1\"}'").count() == 1
    # Every parent key is in a table.
    keys = {(r["rec_id"], r["path"]) for x in t.values() for r in x.collect()}
    assert {(r["rec_id"], r["parent_path"]) for x in t.values() for r in x.collect() if r["parent_path"]} <= keys


def _twin(v, parent=None, depth=0):
    """References by plain recursion over parsed records."""

    def opened(x):
        if isinstance(x, str) and x.strip()[:1] in ("[", "{"):
            try:
                return json.loads(x)
            except ValueError:
                pass
        return x

    def number(x):
        return int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) or isinstance(x, str) and x.strip().isdigit() else None

    if isinstance(v, list):
        for x in v:
            yield from _twin(opened(x), parent, depth + 1)
    if isinstance(v, dict):
        o = {}
        for k, x in v.items():
            o.setdefault(k.lstrip("@_#"), opened(x))
        own = number(o.get("id"))
        if depth and own is not None and o.get("nd") is not None:
            for k, e in enumerate(o["nd"] if isinstance(o["nd"], list) else [o["nd"]]):
                e = opened(e)
                r = number({a.lstrip("@_#"): b for a, b in reversed(e.items())}.get("ref")) if isinstance(e, dict) else number(e)
                if r is not None:
                    yield parent, own, k, r
        for k, x in o.items():
            if k != "tags":
                yield from _twin(x, own if own is not None else parent, depth + 1)


def test_references_against_plain_recursion(spark):
    rng = np.random.default_rng(7)
    pick = lambda *a: a[int(rng.integers(len(a)))]

    def node(depth):
        o = {pick("id", "_id", "@id"): pick(int(rng.integers(1000)), str(rng.integers(1000)), None, "no", True, 2.5) if rng.random() < 0.9 else {"x": 1}}
        if rng.random() < 0.7:
            nd = [pick({"ref": int(rng.integers(99))}, {"_ref": "5"}, 7, "8", None, {"note": 1}, json.dumps({"ref": 6}), [1], {"ref": {"id": 1}}) for _ in range(int(rng.integers(4)))]
            o[pick("nd", "_nd")] = pick(nd, nd, json.dumps(nd), nd[0] if nd else None, {"ref": 3}, {})
        o["tags"] = {"id": 1, "nd": [1]}
        for f in ("members", "inner", "list"):
            if depth < 6 and rng.random() < 0.5:
                kids = [node(depth + 1) for _ in range(int(rng.integers(3)))]
                o[f] = pick(kids, kids, {f"k{k}": x for k, x in enumerate(kids)}, json.dumps(kids), kids[0] if kids else [], [kids])
        return o

    # One deep chain besides: far deeper than anything that calls itself would like.
    deep = {"id": 1, "nd": [1]}
    for k in range(400):
        deep = {"id": k, "m": [deep]}
    all_ = [node(0) for _ in range(150)] + [deep]
    d = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(all_)], "rec_id long, payload string")
    got = sorted((tuple(r) for r in nested.references(nested.shred(d)).select("rec_id", "parent_id", "elem_id", "pos", "ref").collect()), key=str)
    assert got == sorted(((k, *x) for k, v in enumerate(all_) for x in _twin(v)), key=str) and len(got) > 200


def _brute_orphans(versions, refs):
    out = set()
    for src, owner, key, t in refs:
        if key is None or t is None:
            continue
        v = [x for x in versions if x[0] == src and x[1] == key and x[2] <= t]
        last = max(v, key=lambda x: (x[2], x[3])) if v else None
        if last is None or last[3] or (last[4] is not None and last[4] <= t):
            out.add((src, t.strftime("%Y-%m"), owner, key))
    return out


def _random_events(seed, n=400):
    rng = np.random.default_rng(seed)
    when = lambda: datetime(2023, int(rng.integers(1, 4)), int(rng.integers(1, 28)), int(rng.integers(0, 24)))
    # One key has a third of everything.
    key = lambda: 1 if rng.random() < 0.33 else int(rng.integers(2, 40))
    v = list({(s, k, t): (s, k, t, bool(rng.random() < 0.3), when() if rng.random() < 0.2 else None) for s, k, t in (("ab"[int(rng.integers(2))], key(), when()) for _ in range(n // 4))}.values())
    r = [("ab"[int(rng.integers(2))], int(rng.integers(100)), None if rng.random() < 0.05 else key(), when()) for _ in range(n)]
    return v, r + r[:20] + [("a", None, 3, datetime(2022, 12, 31)), ("a", 5, 3, None)]


def _frames(spark, v, r):
    vd = spark.createDataFrame(v, "src string, key long, t timestamp_ntz, dead boolean, drop timestamp_ntz")
    vd = vd.select("src", "key", "t", F.struct("t", "dead", "drop").cast(orphans.STATE).alias("state"))
    return vd, spark.createDataFrame(r, "src string, owner_id long, key long, t timestamp_ntz")


def test_orphans_against_brute_force(spark):
    v, r = _random_events(1)
    vd, rd = _frames(spark, v, r)
    for period in ("day", "month"):
        got = {(x.src, x.ym, x.owner_id, x.key) for x in orphans.orphans(vd, rd, period).collect()}
        assert got == _brute_orphans(v, r)
    assert orphans.orphans(vd, rd.limit(0)).count() == 0
    assert orphans.orphans(vd.limit(0), rd).select("src", "owner_id", "key", "t").distinct().count() == rd.where("key IS NOT NULL AND t IS NOT NULL").distinct().count()


def test_pending_and_incremental_orphans_agree(spark):
    v, r = _random_events(2, 200)
    vd, rd = _frames(spark, v, r)
    whole = {(x.src, x.ym): (x.new_orphans, x.open_at_end) for x in orphans.pending_by_month(vd, rd).collect()}
    distinct = {(s, o, k, t) for s, o, k, t in r if k is not None and t is not None}
    end = datetime(2023, 3, 31, 23, 59, 59)

    def waits(s, o, k, t):
        x = [y for y in v if y[0] == s and y[1] == k]
        last = max(x, key=lambda y: (y[2], y[3])) if x else None
        return last is None or last[3] or (last[4] is not None and last[4] <= end)

    for s in "ab":
        assert whole[(s, "2023-03")][1] == sum(waits(*x) for x in distinct if x[0] == s)
        assert whole[(s, "2023-02")][0] == sum(bool(_brute_orphans(v, [x])) for x in distinct if x[0] == s and x[3].month == 2)
    state, pending, found = vd.limit(0).select("src", "key", "state"), rd.limit(0), set()
    for month in (12, 1, 2, 3):
        part = lambda d: d.where(F.month("t") == month)  # noqa: B023,E731
        state, pending, report = orphans.advance(state, pending, part(vd), part(rd))
        found |= {(x.src, x.owner_id, x.key) for x in report.where("what = 'orphan'").collect()}
        state, pending = state.persist(), pending.persist()
    assert found == {(a, c, d) for a, _, c, d in _brute_orphans(v, r)}


def test_ledger_against_brute_force_and_one_pass(spark):
    v, r = _random_events(5, 200)
    vd, rd = _frames(spark, v, r)
    whole = {(x.src, x.ym): (x.new_orphans, x.open_at_end) for x in orphans.pending_by_month(vd, rd).collect()}
    for period in ("month", "quarter", "year"):
        found, counts = orphans.ledger(vd, rd, period)
        assert {(x.src, x.ym, x.owner_id, x.key) for x in found.collect()} == _brute_orphans(v, r) and found.count() == found.distinct().count()
        n = counts.collect()
        assert sum(x.new_orphans for x in n) == found.count()
        if period == "month":
            got = {(x.src, x.ends.strftime("%Y-%m")): (x.new_orphans, x.open_at_end) for x in n}
            assert {k: x for k, x in got.items() if k in whole} == whole
            assert sum(x.reopened for x in n) > 0 and sum(x.resolved for x in n) > 0
    found, counts = orphans.ledger(vd, rd.limit(0))
    assert found.count() == 0 and sum(x.open_at_end for x in counts.collect()) == 0
    assert orphans.ledger(vd.limit(0), rd.limit(0))[0].count() == orphans.ledger(vd.limit(0), rd.limit(0))[1].count() == 0
    found, counts = orphans.ledger(vd.limit(0), rd)
    assert found.count() == rd.where("key IS NOT NULL AND t IS NOT NULL").distinct().count()


def test_incremental_orphans_reopen(spark):
    v, r = _random_events(2, 200)
    vd, rd = _frames(spark, v, r)
    whole = {(x.src, x.ym): x.open_at_end for x in orphans.pending_by_month(vd, rd).collect()}
    state, pending, reopened = vd.limit(0).select("src", "key", "state"), rd.limit(0), 0
    for ym, end in (("2022-12", datetime(2022, 12, 31, 23, 59, 59)), ("2023-01", datetime(2023, 1, 31, 23, 59, 59)), ("2023-02", datetime(2023, 2, 28, 23, 59, 59)), ("2023-03", datetime(2023, 3, 31, 23, 59, 59))):
        part = lambda d: d.where(F.date_format("t", "yyyy-MM") == ym)  # noqa: B023,E731
        state, pending, report = orphans.advance(state, pending, part(vd), part(rd), end)
        state, pending = state.persist(), pending.persist()
        reopened += report.where("what = 'reopened'").count()
        waiting = {x.src: x.n for x in report.where("what = 'waiting'").groupBy("src").agg(F.count("*").alias("n")).collect()}
        for s in "ab":
            want = whole[max(k for k in whole if k[0] == s and k[1] <= ym)] if any(k[0] == s and k[1] <= ym for k in whole) else 0
            assert pending.where(F.col("open") & (F.col("src") == s)).count() == waiting.get(s, 0) == want
    assert reopened > 0


def test_near_pairs_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    lon = np.concatenate([rng.normal(100, 0.002, 300), np.full(40, 100.0), 180 - rng.uniform(0, 3e-4, 30), -180 + rng.uniform(0, 3e-4, 30), rng.uniform(-180, 180, 40)])
    lat = np.concatenate([rng.normal(40, 0.0005, 300), np.full(40, 40.0), rng.uniform(0, 1e-3, 60), 90 - rng.uniform(0, 3e-4, 40)])
    d = spark.createDataFrame([(i, float(a), float(b), "x") for i, (a, b) in enumerate(zip(lon, lat))] + [(None, 1.0, 1.0, "x"), (9999, None, 1.0, "x"), (9998, float("nan"), 1.0, "x")], "id long, lon double, lat double, strip string")
    want = {(i, j) for i in range(len(lon)) for j in range(i + 1, len(lon)) if spatial.haversine_m(lon[i], lat[i], lon[j], lat[j]) <= 25}
    for crowd in (20_000, 30):
        monkeypatch.setattr(spatial, "SEGMENT_POINTS", crowd)
        got = [tuple(r) for r in spatial.near_pairs(d, 25.0).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert spatial.near_pairs(d.limit(0), 25.0).count() == 0


def test_regions(spark, rows):
    square = [(1, 0, s, x, y) for s, (x, y) in enumerate([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)])]
    hole = [(1, 1, 10 * s, x, y) for s, (x, y) in enumerate([(1, 1), (1, 3), (3, 3), (3, 1)])]
    other = [(2, 0, s, x, y) for s, (x, y) in enumerate([(2, 2), (6, 2), (6, 6), (2, 6)])]
    ring = spark.createDataFrame([(a, b, c, float(x), float(y), 1) for a, b, c, x, y in square + hole + hole + other] + [(1, 0, 99, None, 1.0, 1)], "ring_id long, part_no int, seq int, x double, y double, n int")
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.5), (3, 3.5, 3.5), (4, 9.0, 9.0), (5, None, 1.0), (6, float("nan"), 1.0)], "id long, lon double, lat double")
    assert rows(spatial.regions_of(p, ring)) == [(1, 1), (1, 3), (2, 2), (2, 3)]
    assert spatial.regions_of(p.limit(0), ring).count() == 0 and spatial.regions_of(p, ring.limit(0)).count() == 0
