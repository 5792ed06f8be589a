"""Surrogates for personal data: keyed, of the same kind, gender, script and format, the same for all mentions of one thing and different for different things.

A thing is cut into parts: given and family names, words of streets and mail addresses are drawn by key from pools of invented words; digits and single letters go
through a keyed cipher that is one to one. Spellings that differ by misread signs only count as one word, unless the corpus shows them to be words of
their own. resolve() looks for words that draw the same surrogate, or one that occurs itself, and lets all but one of them draw again.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.persons import MEN, PARTICLES, WOMEN, folded
from orrery.plans.scratch import materialize

#: Most words that draw again or keep a surrogate of their own spelling; they are sent to all executors. More is an error, never cut.
MOST_EXCEPTIONS = 1_000_000
#: Rounds of drawing again, each of which leaves a vanishing share of the one before.
ROUNDS = 50
#: A spelling is a word of its own, not a misread one, if it has no digit, occurs so often, and so often for each time of the most frequent one that looks the same.
OWN_COUNT, OWN_SHARE = 3, 0.2

# Sounds that the pools are made of.
_ONSETS = "b br c ch d dr f fl g gr h j k kl l m n p pr r s st t tr v w z".split()
_VOWELS = "a e i o u ai ei".split()
_CODAS = " l m n r s t nd rt ll".split(" ")
_FAMILY_ENDS = "ford mann ier ez son ley berg eau ado ton ner ini well hart ard ow".split()
_WOMEN_ENDS = "a ia ina ette ine elle ana ita".split()
_MEN_ENDS = "o us rich bert on ard as in".split()
_WOMAN = re.compile(r"(?:[aá]|tte|[iae]ne|elle|ise|ie|ée)$", re.I)


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()[:16], "big")


@lru_cache(maxsize=500_000)
def draw(key: bytes, pool: str, word: str, attempt: int = 0, syllables: int = 2) -> str:
    """A word of a pool ('family', 'woman', 'man', 'street', 'host'), by key. Each further syllable makes the pool about a thousand times as large; after some attempts
    words have one more, so that no pool is ever too small."""
    syllables += attempt // 8
    n, out = _number(key, pool, word, attempt), ""

    def take(choices: list[str]) -> str:
        nonlocal n
        n, k = divmod(n, len(choices))
        return choices[k]

    for k in range(syllables):
        out += take(_ONSETS) + take(_VOWELS) + (take(_CODAS) if k + 1 < syllables else "")
    if pool in ("woman", "man"):
        out = out.rstrip("aeiou") or out
    elif pool != "host":
        out += take(_CODAS)
    ends = {"woman": _WOMEN_ENDS, "man": _MEN_ENDS, "host": [""]}.get(pool, _FAMILY_ENDS)
    return out + take(ends)


@lru_cache(maxsize=4096)
def _letters(first: int, upper: bool) -> str:
    """Letters of the script of a sign, near it."""
    script = unicodedata.name(chr(first), "").split(" ")[0]
    kind = unicodedata.category(chr(first))
    return "".join(chr(c) for c in range(max(0x80, first - 256), min(0x10FFFF, first + 256)) if unicodedata.category(chr(c)) == kind and unicodedata.name(chr(c), "").split(" ")[0] == script)


def _other_script(key: bytes, word: str, canon: str) -> str:
    """A word of another script than Latin: each letter by key another one of its script."""
    out = []
    for k, c in enumerate(word):
        a = _letters(ord(c), c.isupper()) if c.isalpha() else ""
        out.append(a[_number(key, "letter", canon, k) % len(a)] if a else c)
    return "".join(out)


_TURNS: dict[tuple, tuple[int, ...]] = {}
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "0123456789")


def _turn(key: bytes, kind: str, before: str, n: int) -> tuple[int, ...]:
    """A keyed order of n signs that depends on what stands before."""
    known = (key, kind, before, n)
    if known in _TURNS:
        return _TURNS[known]
    order, k, stream = list(range(n)), 0, b""
    for i in range(n - 1, 0, -1):
        if k >= len(stream) - 1:
            stream, k = hmac.new(key, f"{kind}|{before}|{i}".encode(), hashlib.sha256).digest(), 0
        j = int.from_bytes(stream[k : k + 2], "big") % (i + 1)
        k += 2
        order[i], order[j] = order[j], order[i]
    if len(_TURNS) > 200_000:
        _TURNS.clear()
    _TURNS[known] = tuple(order)
    return _TURNS[known]


def encipher(value: str, kind: str, key: bytes) -> str:
    """Digits and letters by a keyed order that depends on the digits and letters before: one to one, of the same format."""
    out, before = [], ""
    for c in value:
        low = c.lower()
        for cls in _CLASSES:
            at = cls.find(low) if low else -1
            if at >= 0:
                new = cls[_turn(key, kind, before, len(cls))[at]]
                out.append(new.upper() if c.isupper() else new)
                before += low
                break
        else:
            out.append(c)
    return "".join(out)


_MISREAD = str.maketrans("OolISB", "001158")
_PART = re.compile(r"[^\W\d_][\w’'ſ]*|\d[\w’'ſ]*")
_KEPT_STREET = re.compile(
    r"(?i)(?:street|st|road|rd|row|lane|crescent|terrace|avenue|ave|av|square|drive|court|place|close|gardens|grove|mews|boulevard|bd|rue|quai|impasse|chemin|allée|cours|passage|sentier|calle|c|avenida|avda|plaza|pza|callejón|paseo|ronda|cuesta|travesía|camino|"
    r"via|viale|piazza|corso|de|la|las|los|del|du|des|d|l|aux|le|n|no|nº|núm|bis|ter|upper|lower|old|new|obere|untere|alte|neue|große|kleine|hintere|vordere)$"
)
_COMPOUND = re.compile(r"(?i)(.{2,}?)(straße|strasse|str|weg|gasse|platz|allee|ufer|damm|ring|steig|markt)$")


def canon(word: str) -> str:
    """What the spellings of a word have in common that differ by misread signs."""
    return folded(word)


def gender(given: str) -> str:
    """'woman' or 'man', by the common names and else by the ending."""
    title = given.title()
    return "woman" if title in WOMEN else "man" if title in MEN else "woman" if _WOMAN.search(given) else "man"


class Maker:
    """Makes surrogates. exceptions: {(pool, word or canon): (what is drawn by, attempt)} as resolve() finds them."""

    def __init__(self, key: bytes, exceptions: dict[tuple[str, str], tuple[str, int]] | None = None, syllables: int = 2):
        self.key, self.exceptions, self.syllables = key, exceptions or {}, syllables
        self.seen: dict[tuple[str, str], str] = {}
        self.used: Counter | None = None

    def word(self, pool: str, word: str) -> str:
        """The surrogate of one word; capital letters stay where they are typical: all, the first, or none."""
        low = word.lower()
        if self.used is not None:
            self.used[pool, canon(word), low] += 1
        got = self.seen.get((pool, low))
        if got is None:
            c = canon(word)
            by, attempt = self.exceptions.get((pool, low)) or self.exceptions.get((pool, c)) or (c, 0)
            letters = [x for x in word if x.isalpha()]
            latin = not letters or unicodedata.name(letters[0], "").startswith("LATIN")
            got = draw(self.key, pool, by, attempt, self.syllables) if latin else _other_script(self.key, low, by)
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[pool, low] = got
        return got.upper() if word.upper() == word and len(word) > 1 else got[:1].upper() + got[1:] if word[:1].isupper() or word[:1].isdigit() else got

    def name(self, read: str) -> str:
        """Given names of the same gender, initials, particles as they are, family names."""
        comma = ", " in read
        words = [(m.start(), m.end()) for m in re.finditer(r"[\w’'ſ]+(?:-[\w’'ſ]+)*", read)]
        particles = {w for p in PARTICLES for w in p.split()}
        big = [k for k, (a, b) in enumerate(words) if read[a:b] not in particles]
        family = ({big[0]} if comma else {big[-1]}) if big else set()
        out, p = [], 0
        for k, (a, b) in enumerate(words):
            w = read[a:b]
            if w in particles:
                new = w
            elif len(w) == 1:
                new = encipher(w, "initial", self.key)
            elif k in family:
                new = "-".join(self.word("family", x) for x in w.split("-"))
            else:
                new = "-".join(self.word(gender(x), x) for x in w.split("-"))
            out += [read[p:a], new]
            p = b
        return "".join(out) + read[p:]

    def number(self, read: str, kind: str) -> str:
        """Digits, and letters of registries, by the cipher; a country's code and the zero before an area stay. Misread digits count as digits."""
        x = list(read)
        for k, c in enumerate(x):
            if c in "OolISB":
                near = [y for y in (read[k - 1 : k], read[k + 1 : k + 2]) if y]
                wide = re.sub(r"[^\w]", "", read[max(0, k - 3) : k])[-1:] + re.sub(r"[^\w]", "", read[k + 1 : k + 4])[:1]
                if any(y.isdigit() for y in near) or (wide and wide.isdigit()):
                    x[k] = c.translate(_MISREAD)
        s = "".join(x)
        m = re.match(r"(?:\+ ?|00)\d{1,2}(?=\D|$)|\(?0", s) if kind == "phone" else None
        head = m[0] if m else ""
        return head + encipher(s[len(head) :], kind, self.key)

    def phone(self, read: str) -> str:
        """The exchange's name, if any, stays."""
        m = re.match(r"(?:[^\W\d][\w’-]{2,} )+", read)
        head = m[0] if m else ""
        return head + self.number(read[len(head) :], "phone")

    def address(self, read: str) -> str:
        out, p = [], 0
        for m in _PART.finditer(read):
            w = m[0]
            if any(c.isdigit() for c in w) and (len(w) < 5 and (w[0].isdigit() or w[0] in "OolISB")):
                new = encipher(w.translate(_MISREAD) if not w[-1:].isalpha() else w, "house", self.key)
                new = ("1" + new[1:]) if new[:1] == "0" and len(new) < 2 else new
            elif _KEPT_STREET.match(w):
                new = w
            elif c := _COMPOUND.match(w):
                new = self.word("street", c[1]) + c[2]
            else:
                new = self.word("street", w)
            out += [read[p : m.start()], new]
            p = m.end()
        return "".join(out) + read[p:]

    def email(self, read: str) -> str:
        """Words of the local part as in names; words of the host; its last word and all signs stay."""
        words = list(re.finditer(r"[^\W\d_]+|\d+", read))
        at = re.search(r"[@©®]|[(\[] ?[a@][tf]? ?[)\]]| [a@][tf] ", read, re.I)
        cut = at.start() if at else len(read)
        stop = at.end() if at else len(read)
        out, p = [], 0
        for k, m in enumerate(words):
            w = m[0]
            if cut <= m.start() < stop or (m.start() >= stop and (k + 1 == len(words) or w.lower() in ("dot", "dof", "d0t"))):
                new = w
            elif w[0].isdigit():
                new = encipher(w, "mail", self.key)
            elif len(w) == 1:
                new = encipher(w, "initial", self.key)
            else:
                new = self.word("family" if m.start() < cut else "host", w)
            out += [read[p : m.start()], new]
            p = m.end()
        return "".join(out) + read[p:]

    def make(self, kind: str, read: str) -> str:
        """The surrogate of a thing as it is read."""
        read = " ".join(read.split())
        if kind == "name":
            return self.name(read)
        if kind == "phone":
            return self.phone(read)
        if kind == "address":
            return self.address(read)
        return self.email(read) if kind == "email" else self.number(read, kind)


def words_of(found: DataFrame) -> DataFrame:
    """(pool, canon, word, n): the words of what was found (kind, found), as they are spelled, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Maker(b"")
        pack = lambda u: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*zip(*u), list(u.values())), (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["pool", "canon", "word", "n"])
        maker.used = Counter()
        for b in batches:
            for kind, read in zip(b.column("kind").to_pylist(), b.column("found").to_pylist()):
                if kind and read:
                    maker.make(kind, read)
            if len(maker.used) > 50_000:
                yield pack(maker.used)
                maker.used = Counter()
        if maker.used:
            yield pack(maker.used)

    got = found.select("kind", "found").mapInArrow(run, "pool string, canon string, word string, n bigint")
    return got.groupBy("pool", "canon", "word").agg(F.sum("n").alias("n"))


def resolve(words: DataFrame, key: str, syllables: int = 2, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(drawn, own): what each word is drawn by (pool, word, attempt, surrogate), no two of a pool with the same surrogate and none whose surrogate looks like
    a word of the pool that occurs; and the spellings (pool, word) that are words of their own though they look like a more frequent one.

    words as words_of() gives them. Words that look the same draw once. No words give no rows. Raises if `rounds` do not suffice.
    """
    secret = key.encode()
    words = materialize(words, "surrogate-words")
    top = words.groupBy("pool", "canon").agg(F.max_by("word", F.struct("n", "word")).alias("first"), F.max("n").alias("most"))
    own = words.join(top, ["pool", "canon"]).where((F.col("word") != F.col("first")) & (F.col("n") >= OWN_COUNT) & (F.col("n") >= OWN_SHARE * F.col("most")) & ~F.col("word").rlike("[0-9]"))
    own = materialize(own.select("pool", "word"), "surrogate-own")
    occurring = top.select("pool", "canon").unionByName(own.select("pool", F.col("word").alias("canon"))).distinct()
    todo = materialize(occurring.select("pool", F.col("canon").alias("word"), F.lit(0).alias("attempt")), "surrogate-todo")
    looks = top.select("pool", F.col("canon").alias("looks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [draw(secret, p, w, a, syllables) for p, w, a in zip(*(b.column(c).to_pylist() for c in ("pool", "word", "attempt")))]
            yield b.append_column("surrogate", pa.array(got, pa.string())).append_column("looks", pa.array([canon(g) for g in got], pa.string()))

    settled: list[DataFrame] = []
    for _ in range(rounds):
        drawn = materialize(todo.mapInArrow(run, "pool string, word string, attempt int, surrogate string, looks string"), "surrogate-drawn")
        best = drawn.groupBy("pool", "looks").agg(F.min("word").alias("keeps"))
        free = best.join(looks, ["pool", "looks"], "left_anti")
        for old in settled:
            free = free.join(old.select("pool", "looks"), ["pool", "looks"], "left_anti")
        judged = materialize(drawn.join(free, ["pool", "looks"], "left").withColumn("ok", F.coalesce(F.col("keeps") == F.col("word"), F.lit(False))).drop("keeps"), "surrogate-judged")
        settled.append(judged.where("ok").drop("ok"))
        todo = judged.where("NOT ok").select("pool", "word", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            break
    else:
        raise RuntimeError(f"surrogates still collide after {rounds} rounds: give more syllables")
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out.drop("looks"), own


def exceptions(drawn: DataFrame, own: DataFrame) -> dict[tuple[str, str], tuple[str, int]]:
    """What Maker has to know: words that draw again, and spellings that are drawn by themselves. Raises if they are more than MOST_EXCEPTIONS."""
    own = own.withColumn("own", F.lit(True)).join(drawn, ["pool", "word"])
    rows = drawn.where("attempt > 0").select("pool", "word", "attempt").unionByName(own.select("pool", "word", "attempt")).distinct().limit(MOST_EXCEPTIONS + 1).collect()
    if len(rows) > MOST_EXCEPTIONS:
        raise ValueError(f"more than {MOST_EXCEPTIONS} words need a draw of their own: give more syllables")
    return {(r["pool"], r["word"]): (r["word"], r["attempt"]) for r in rows}
