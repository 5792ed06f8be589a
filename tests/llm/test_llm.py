"""Corpus operators on small and dirty inputs, against brute force, round trips and planted cases."""

import math
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import clusters, mixing, pii, similar, surrogates, tokens
from orrery.operators.spatial import haversine_m

# ---------------------------------------------------------------- clusters


def _chains(ids, lon, lat, eps, least):
    n, root = len(ids), list(range(len(ids)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i in range(n):
        for j in np.nonzero(haversine_m(lon[i], lat[i], lon[i + 1 :], lat[i + 1 :]) <= eps)[0] + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    groups: dict = {}
    for k in range(n):
        groups.setdefault(find(k), []).append(ids[k])
    return {(k, min(g)) for g in groups.values() if len(g) >= least for k in g}


def _cloud(seed):
    rng = np.random.default_rng(seed)
    lon = np.concatenate([rng.normal(100, 0.002, 250), np.full(80, 100.01), 100.02 + rng.uniform(0, 1e-4, 150), 100.0209 + rng.uniform(0, 3e-4, 150), np.where(rng.random(60) < 0.5, -1, 1) * (180 - rng.uniform(0, 1e-3, 60)), rng.uniform(-180, 180, 60)])
    lat = np.concatenate([rng.normal(40, 0.002, 250), np.full(80, 40.01), 40 + rng.uniform(0, 3e-4, 300), rng.uniform(5, 5.003, 60), 90 - np.abs(rng.normal(0, 0.001, 60))])
    return lon, lat


def test_clusters_are_exact(spark, monkeypatch):
    lon, lat = _cloud(1)
    ids = np.arange(len(lon)) * 3 + 1
    d = spark.createDataFrame([(int(i), float(a), float(b), 0) for i, a, b in zip(ids, lon, lat)] + [(None, 1.0, 1.0, 0), (7000, None, 1.0, 0), (7001, 1.0, float("nan"), 0)], "id long, lon double, lat double, r int")
    want = _chains(ids, lon, lat, 60, 5)
    for batch in (50_000, 200):
        monkeypatch.setattr(clusters, "BATCH", batch)
        got = [tuple(r) for r in clusters.clusters(d).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    m = clusters.clusters(d)
    c = {r["cluster_id"]: r for r in clusters.describe(d, m).collect()}
    for k, r in c.items():
        mine = [i for i, g in want if g == k]
        assert r["size"] == len(mine) and set(r["medoids"]) <= set(mine) and len(r["medoids"]) == 3
    hot = [k for k, (a, b) in zip(ids, zip(lon, lat)) if a == 100.01]
    assert set(c[min(hot)]["medoids"]) == set(sorted(hot)[:3])
    assert clusters.clusters(d.limit(0)).count() == 0


def test_chain_across_tiles(spark):
    p = [(i, 10.0 + i * 0.0005, 50.0) for i in range(200)]  # steps of about 36 m over several tiles
    d = spark.createDataFrame(p, "id long, lon double, lat double")
    assert {r["cluster_id"] for r in clusters.clusters(d).collect()} == {0} and clusters.clusters(d).count() == 200
    assert clusters.clusters(d, 30.0).count() == 0


def test_density_clusters_against_brute_force(spark):
    rng = np.random.default_rng(11)
    # A crowded place, a street, a sparse field, both sides of the antimeridian, the pole, copies.
    lon = np.concatenate([rng.normal(100, 2e-4, 200), 100.01 + np.arange(40) * 5e-4, rng.uniform(100, 100.02, 60), 180 - rng.uniform(0, 5e-4, 12), -180 + rng.uniform(0, 5e-4, 12), rng.uniform(-180, 180, 30), np.full(20, 101.0)])
    lat = np.concatenate([rng.normal(40, 2e-4, 200), np.full(40, 40.01), rng.uniform(40.01, 40.03, 60), rng.uniform(0, 5e-4, 24), 90 - rng.uniform(0, 4e-4, 30), np.full(20, 41.0)])
    ids = rng.permutation(len(lon))
    d = spark.createDataFrame([(int(i), float(a), float(b), "x") for i, a, b in zip(ids, lon, lat)] + [(None, 1.0, 1.0, "x"), (9999, None, 1.0, "x"), (9998, float("nan"), 1.0, "x")], "id long, lon double, lat double, core string")
    near = np.stack([haversine_m(lon[i], lat[i], lon, lat) <= 60 for i in range(len(lon))])
    for least in (1, 4, 30):
        core = near.sum(1) >= least
        label = {i: ids[i] for i in np.nonzero(core)[0]}
        while True:
            new = {i: min(label[j] for j in np.nonzero(near[i] & core)[0]) for i in label}
            if new == label:
                break
            label = new
        want = {int(ids[i]): int(c) for i, c in label.items()}
        want |= {int(ids[i]): int(min(label[j] for j in np.nonzero(near[i] & core)[0])) for i in np.nonzero(~core)[0] if (near[i] & core).any()}
        got = {r["id"]: r["cluster_id"] for r in clusters.density_clusters(d, 60.0, least).collect()}
        assert got == want
    assert clusters.density_clusters(d.limit(0), 60.0, 4).count() == 0


# ---------------------------------------------------------------- similar vectors


def _vectors(seed, n=400, dims=48):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n // 8, dims))
    return centers[rng.integers(len(centers), size=n)] + rng.normal(scale=0.15, size=(n, dims))


def _best(x, k, least):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    return {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -s[i]))[:k] if s[i, j] >= least}


def test_similar_recall(spark, monkeypatch):
    x = _vectors(2)
    dirty = [(5000, None), (5001, [1.0] * 47), (5002, [float("nan")] * 48), (5003, [0.0] * 48), (None, [1.0] * 48), (5004, [float("inf")] * 48), (5005, [1.0] * 47 + [None])]
    d = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)] + [(i, v, 1) for i, v in dirty], "id long, x array<double>, unit int")
    want = _best(x, 5, 0.9)
    for bucket, least in ((1000, 0.97), (20, 0.9)):
        monkeypatch.setattr(similar, "BUCKET", bucket)
        got = {(r["id"], r["other"]) for r in similar.similar(d, 48, 5, 0.9).collect()}
        assert len(got & want) >= least * len(want)
    assert similar.similar(d.limit(0), 48).count() == 0


def test_copies_of_a_vector(spark):
    x = _vectors(3, 40)
    hot = [(100 + k, x[0].tolist()) for k in range(60)]  # more than half of all rows are one vector
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + hot + [(900, (x[0] * 7).tolist())], "id long, x array<double>")
    got: dict = {}
    for r in similar.similar(d, 48, 5, 0.9).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["other"])
    assert got[0] == [100, 101, 102, 103, 104] and got[150] == [0, 100, 101, 102, 103] and got[900] == [0, 100, 101, 102, 103]
    assert all(len(set(v)) == len(v) for v in got.values()) and all(k in got for k in range(100, 160))


def test_near_copies_of_a_vector(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([c + rng.normal(scale=noise, size=(200, 48)) for c, noise in zip(rng.normal(size=(3, 48)), (1e-3, 1e-5, 1e-7))])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = {(r["id"], r["other"]) for r in similar.similar(d, 48, 5, 0.9).collect()}
    want = _best(x, 5, 0.9)
    assert len(got & want) >= 0.99 * len(want)


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64)).astype(np.float32)
    y = similar._hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1), rtol=1e-4) and np.allclose(similar._hadamard(y), x, atol=1e-4)


# ---------------------------------------------------------------- tokens

TEXTS = [None, "", "   ", "Hello world, the Quillon\n Heath  \t\t x", "ſﬁ é à 日本語🙂🙂 <|endoftext|> don't I'LL", "x\r\n\n\ny  z  w　", "ab" * 400 + " q", "zqxjkvbpyg" * 60, "1234567890½²³ ́abc\x1c\x1d", "’“¬­—" * 30]


@pytest.fixture(scope="module")
def codec():
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=tokens.ranks(tokens.vocabulary_path()), special_tokens={})


def test_encoding_matches_the_library_and_comes_back(spark, codec):
    d = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "copy"), (None, "null key", "x")], "doc_id long, text string, w string")
    out = tokens.encode(d)
    got = out.collect()
    by = {k: t for k, t in enumerate(TEXTS)} | {None: "null key"}
    assert len(got) == len(TEXTS) + 2 and all(list(r["ids"]) == codec.encode_ordinary(by[r["doc_id"]] or "") for r in got)
    assert all(r["text"] == (by[r["doc_id"]] or "") for r in tokens.decode(out).collect())
    assert {(r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(d.withColumn("n_tokens", F.lit("x"))).collect()} == {(k, len(codec.encode_ordinary(t or ""))) for k, t in by.items()}
    assert tokens.encode(d.limit(0)).count() == 0


def test_decode_of_odd_lists(spark):
    d = spark.createDataFrame([(1, None), (2, []), (3, [50_000_000]), (4, [-1])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in tokens.decode(d).collect()} == {1: None, 2: "", 3: None, 4: None}


# ---------------------------------------------------------------- mixtures


def _fill(sizes, target, cap, total):
    """Filling up by bisection of the level."""
    lo, hi = 0.0, 1e12
    most = {s: cap[s] * sizes.get(s, 0) for s in target}
    total = min(total, sum(most.values()))
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most[s], mid * target[s]) for s in target) < total else (lo, mid)
    return {s: min(most[s], hi * target[s]) for s in target}


def test_weights_of_a_curriculum_always_sum_to_one(spark):
    plan = spark.createDataFrame([("a", 0.7, 0.1, 7.0), ("b", 0.2, 9.0, 2.0), ("c", 0.1, 1.0, 1.0), ("d", 0.0, 0.0, 0.0)], "source string, planned_share double, repeats double, planned double")
    for strength in (0.0, 0.5, 1.0, 5.0):
        rows = mixing.curriculum(plan, strength).collect()
        for t in (0.0, 0.3, 1.0):
            w = [r["planned_share"] * (1 + r["slope"] * (2 * t - 1)) for r in rows]
            assert math.isclose(sum(w), 1.0, abs_tol=1e-12) and min(w) >= 0
        assert (max(abs(r["slope"]) for r in rows) > 0) == (strength > 0)


def test_mixture(spark):
    rng = np.random.default_rng(4)
    # One source holds most rows, another has none, one is spelled in several ways.
    docs = [(k, ["big", "Big ", "BIG"][k % 3], int(rng.integers(1, 50))) for k in range(900)] + [(1000 + k, "small-one" if k % 2 else "small_one", 20) for k in range(40)] + [(2000, None, 5), (2001, "other", 5), (2002, "big", None), (2003, "big", 0)]
    d = spark.createDataFrame([(*r, 1.0) for r in docs], "doc_id long, source string, n_tokens long, due double")
    t = spark.createDataFrame([("big", 0.6, 1.0), ("small_one", 0.3, 2.5), ("gone", 0.1, 4.0), ("big", 0.6, 1.0)], "source string, target_share double, max_repeat double")
    used, report = mixing.mix(d, t)
    rep = {r["source"]: r for r in report.collect()}
    sizes = {"big": sum(r[2] or 0 for r in docs if r[1] and r[1].strip().lower() == "big"), "small_one": 800}
    plan = _fill(sizes, {"big": 0.6, "small_one": 0.3, "gone": 0.1}, {"big": 1.0, "small_one": 2.5, "gone": 4.0}, sum(sizes.values()))
    for s, want in plan.items():
        assert math.isclose(rep[s]["planned"], want, rel_tol=1e-6, abs_tol=1e-6)
        assert want - 50 < rep[s]["used_tokens"] <= want + 1e-6
    assert rep["gone"]["used_tokens"] == 0 and rep[None]["used_tokens"] == 0 and rep["other"]["planned"] == 0
    rows = mixing.in_order(used).collect()
    assert [r["due"] for r in rows] == sorted(r["due"] for r in rows) and all(0 <= r["due"] <= 1 for r in rows)
    uses: dict = {}
    for r in rows:
        uses.setdefault(r["doc_id"], []).append(r["copy_no"])
    assert all(sorted(v) == list(range(len(v))) for v in uses.values())
    assert max(len(v) for k, v in uses.items() if 1000 <= k < 1040) <= 3
    # At any time each source has given what its schedule says, give or take a document.
    for s in ("big", "small_one"):
        slope = {r["source"]: r["slope"] for r in mixing.curriculum(report, 0.5).collect()}[s]
        for now in (0.25, 0.5, 0.75):
            given = sum(r["n_tokens"] for r in rows if r["source"] == s and r["due"] <= now)
            assert abs(given / plan[s] - (now + slope * (now * now - now))) < 60 / plan[s]
    # One row repeated beyond a stride: every copy is a document of its own.
    same = spark.range(25_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("big").alias("source"), F.lit(3).cast("bigint").alias("n_tokens"))
    assert mixing.mix(same, t)[0].count() == 25_000
    empty, report = mixing.mix(d.limit(0), t)
    assert empty.count() == 0 and report.count() == 3
    assert mixing.mix(d, t.limit(0))[0].count() == 0


# ---------------------------------------------------------------- personal information

NAMES = [("Jorina",), ("Jorard",), ("Joric",), ("Rosina",), ("Rosard",), ("Rosric",), ("Velwin",), ("ORSINE",), (None,), ("",)]
PAGE = """Apply in writing to Jorina van Hollobach, 31 Gravel Pit Cres-
cent, Elmstow. Dr. Lindquist, who may be reached
at +44 1632 96O139. Lot 940-37-8422 was sold; Insurance
number 94O-37-8423 and QQ 12 34 56 C. Messrs. Lindquist & Sons
and the steamer Rosina Star lie near Marrow Street. Write to
rosard.garworth+x(at)mail.example or jo at post dot test.
ASK YOUR GROCER
Mrs. Ket-
mire, ORSINE STEINBACH, and Holloworth, Velwin. 14 Kiln horses.
Tel. Elmstow 849. Rue des Tanneurs, 12 bis, rue des Tanneurs;
Salzstr. 14a; Calle del Molino, nº 7; price £12."""


def test_found_in_a_page(spark):
    d = spark.createDataFrame([(1, PAGE, None, 0), (2, None, None, 0), (3, "", [], 0), (4, "  \n ", None, 0), (5, PAGE.replace("\n", "\r\n"), None, 0), (None, "Mr. Hollobach", None, 0)], "doc_id long, text string, page_lines array<struct<c0:int,c1:int,x0:int,y0:int,x1:int,y1:int,conf:float>>, kind int")
    names = spark.createDataFrame(NAMES, "given string")
    got = pii.detect(d, names).collect()
    want = {
        "name": ["Jorina van Hollobach", "Lindquist, who", "Ket-\nmire", "ORSINE STEINBACH", "Holloworth, Velwin"], "address": ["31 Gravel", "12 bis, rue", "Salzstr. 14a", "Calle del Molino"],
        "phone": ["+44 1632", "Elmstow 849"], "idno": ["94O-37-8423", "QQ 12"], "email": ["rosard.garworth", "jo at post"],
    }
    cases = {(k, PAGE.index(x)) for k, v in want.items() for x in v}
    assert {(r["kind"], r["start_pos"]) for r in got if r["doc_id"] == 1} == cases
    assert len([r for r in got if r["doc_id"] == 5]) == len(cases) and [r["start_pos"] for r in got if r["doc_id"] is None] == [4]
    assert pii.detect(d.limit(0), names).count() == 0 and pii.detect(d, names.limit(0)).where("kind = 'email'").count() == 4
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymize(d, names, "k").collect()}
    assert out[2] is None and out[3] == "" and "Hollobach" not in out[1] and "Messrs. Lindquist & Sons" in out[1] and out[1].count("<name>") == 5 and "</phone>. Lot 940-37-8422" in out[1]
    assert {(r["pool"], r["still_colliding"]) for r in pii.collisions(d, names, "k").collect()} == {(p, 0) for p in ("family", "woman", "street", "host", "man")}
    assert pii.pseudonymize(d.limit(0), names, "k").count() == 0 and pii.collisions(d.limit(0), names, "k").count() == 0


PLAIN = [
    ("John Smith met Mr. Thompson and Dr. Mary Johnson.", [("name", "John Smith"), ("name", "Thompson"), ("name", "Mary Johnson")]),
    ("Gestern trafen sich Hans Müller und Frau von Bülow in Berlin.", [("name", "Hans Müller"), ("name", "von Bülow")]),
    ("Pierre Dupont et Mme Lefèvre sont venus.", [("name", "Pierre Dupont"), ("name", "Lefèvre")]),
    ("José García y la señora Martínez viven aquí.", [("name", "José García"), ("name", "Martínez")]),
    ("Signed by J. R. Whitfield; see also Whitfield, J. and Okafor, Mary.", [("name", "J. R. Whitfield"), ("name", "Whitfield, J."), ("name", "Okafor, Mary")]),
    ("Messrs. Smith & Sons, the steamer Mary Queen and the Albert Bank closed in Port Arthur.", []),
    ("Call +44 20 7946 0958 or +1-212-555-0147 or (212) 555-0147.", [("phone", "+44 20"), ("phone", "+1-212"), ("phone", "(212)")]),
    ("He lives at 221B Baker Drive, she at 10 Downing Court, they in Via Roma 12.", [("address", "221B"), ("address", "10 Downing"), ("address", "Via Roma")]),
    ("Insurance AB 12 34 56 C; lot AB123456C; passport no. X12345678.", [("idno", "AB 12"), ("idno", "X12345678")]),
    ("Mail mary.johnson@example.co.uk or mary at example dot com.", [("email", "mary.johnson"), ("email", "mary at")]),
    ("FINEST TEAS OF MRS. GARWORTH, TEL. 212-555-0147", [("name", "GARWORTH"), ("phone", "212-555")]),
    ("The 100 000 000 francs, 1 250 000 men and 14 Upper Tannery horses of Section B. The rest left.", []),
]


def test_plain_sentences_without_any_list():
    names = pii.Names()
    for text, want in PLAIN:
        got = sorted((s, kind) for kind, s, *_ in pii.find(text, {}, names))
        assert got == sorted((text.index(x), kind) for kind, x in want), text


def test_lines_in_capitals_are_read_on_their_own():
    text = "Those present met Mary\nFINEST TEAS OF MRS. GARWORTH, TEL. 212-555-0147 ONLY\nJohnson of Leeds, who had come\nearly.\n"
    got = {(k, read) for k, _, _, read, _ in pii.find(text, {}, pii.Names())}
    assert got == {("name", "Mary Johnson"), ("name", "GARWORTH"), ("phone", "212-555-0147")}


def test_endings_come_from_the_list():
    listed = {h + e for h in ("Jor", "Vel", "Cor", "Tam", "Ild", "Sev", "Ros") for e in ("ina", "ard", "ette", "win")} - {"Jorina", "Rosard", "Tamwin"}
    names = pii.Names(tuple(listed))
    assert names.is_given("Jorina") == names.is_given("Rosard") == "G" and names.is_given("Table") == "" and names.is_given("Velwiin") == "g"


def test_columns_are_read_in_order():
    names = pii.Names(tuple(n for n, in NAMES if n))
    left, right = ["Apply to Jorina", "Hollobach, 31", "Kiln Row."], ["Dr.", "Lindquist is", "away today."]
    side = "\n".join(f"{a:<20}{b}" for a, b in zip(left, right))
    kinds = lambda t, boxes={}: sorted((k, read) for k, _, _, read, _ in pii.find(t, boxes, names))  # noqa: B006,E731
    want = [("address", "31 Kiln Row"), ("name", "Jorina Hollobach"), ("name", "Lindquist")]
    assert kinds(side) == want
    lines, boxes, text = [x for p in zip(left, right) for x in p], {}, ""
    for k, x in enumerate(lines):
        boxes[len(text)] = (100 + 800 * (k % 2), 100 + 40 * (k // 2))
        text += x + "\n"
    assert kinds(text, boxes) == want


def test_surrogates_keep_kind_gender_script_and_format():
    m = surrogates.Maker(b"k")
    a, b, c = (m.make("name", x) for x in ("Jorina van Hollobach", "Mr. Hollobach"[4:], "Hollobach, Jorina"))
    assert a.split()[1] == "van" and a.split()[2] == b == c.split(",")[0] and a.split()[0] == c.split()[1]
    # Misread mentions are the same person, capital letters stay.
    assert m.make("name", "Ho1lobach") == b and m.make("name", "HOLLOBACH") == b.upper() and m.make("name", "J. Hollobach").split()[1] == b
    assert surrogates.gender("Jorina") == surrogates.gender("Mary") == "woman" and surrogates.gender("Hans") == surrogates.gender("Jorard") == "man"
    woman, man = m.make("name", "Mary Smith").split()[0], m.make("name", "Hans Smith").split()[0]
    assert surrogates.gender(woman) == "woman" and surrogates.gender(man) == "man" and m.make("name", "Mary Smith-Jones").split()[1].count("-") == 1
    greek = m.make("name", "Νίκος Παπάς")
    assert len(greek) == len("Νίκος Παπάς") and all("GREEK" in unicodedata.name(x) for x in greek if x.isalpha()) and greek != "Νίκος Παπάς"
    phones = [f"+44 1632 {n:06d}" for n in range(3000)]
    made = [m.make("phone", p) for p in phones]
    assert len(set(made)) == 3000 and all(x.startswith("+44 ") and x[8] == " " and len(x) == 15 for x in made)
    assert m.make("phone", "Central O570") == m.make("phone", "Central 0570") and m.make("phone", "Central 0570").startswith("Central 0")
    assert m.make("idno", "94O-37-8423") == m.make("idno", "940-37-8423") and re.fullmatch(r"[A-Z]{2} \d\d \d\d \d\d [A-Z]", m.make("idno", "QQ 12 34 56 C"))
    street = m.make("address", "31, Gravel Pit Street")
    assert re.fullmatch(r"\d\d, [A-Z]\w+ [A-Z]\w+ Street", street) and "Gravel" not in street and m.make("address", "Kastenstraße 22").split()[0].endswith("straße")
    mail = m.make("email", "jorina.hollobach49@mail.elmstow.test")
    assert mail.split("@")[0].split(".")[1][: len(b)] == b.lower() and mail.endswith(".test") and "elmstow" not in mail
    assert m.make("email", "jo at post dot test").split()[1::2] == ["at", "dot"]


def test_colliding_surrogates_are_drawn_again(spark):
    words = [f"w{k}x{'abcdefghij'[k % 10]}" for k in range(900)]
    same = [("family", surrogates.canon("Harmire"), "harmire", 9), ("family", surrogates.canon("Hanmire"), "hanmire", 8), ("family", surrogates.canon("Harmire"), "harm1re", 7), ("family", surrogates.canon("Harmire"), "harmine", 1)]
    d = spark.createDataFrame([("woman", surrogates.canon(w), w, 1) for w in words] + same, "pool string, canon string, word string, n long")
    # One syllable makes a pool so small that words collide.
    drawn, own = surrogates.resolve(d, "k", syllables=1)
    rows = drawn.collect()
    assert len({(r["pool"], r["surrogate"]) for r in rows}) == len(rows) and max(r["attempt"] for r in rows) > 0
    looks = {surrogates.canon(w) for w in words}
    assert not [r for r in rows if r["pool"] == "woman" and surrogates.canon(r["surrogate"]) in looks]
    assert [r["word"] for r in own.collect()] == ["hanmire"]
    m = surrogates.Maker(b"k", surrogates.exceptions(drawn, own), 1)
    assert len({m.word("woman", w) for w in words}) == len({surrogates.canon(w) for w in words})
    assert m.word("family", "harm1re") == m.word("family", "harmire") == m.word("family", "harmine") != m.word("family", "hanmire")


def test_very_long_text(spark):
    text = ("word " * 40_000) + "Mr. Hollobach " + "x" * 20_000
    d = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("page_lines", F.lit(None).cast("array<struct<c0:int,c1:int,x0:int,y0:int,x1:int,y1:int,conf:float>>"))
    assert [r["start_pos"] for r in pii.detect(d, spark.createDataFrame(NAMES, "given string")).collect()] == [200_004]
    ids = tokens.encode(d).first()["ids"]
    assert len(ids) > 40_000
