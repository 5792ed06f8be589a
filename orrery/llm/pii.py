"""Personal information in the text of scanned pages: found, marked by kind and replaced by keyed surrogates.

A page is first brought into reading order (columns, line-end hyphens, insertions between lines); rules for each kind then run on that, tolerant
of misread characters, and places are carried back to the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.persons import Names, find_names, folded, word_before
from orrery.llm.surrogates import Maker, exceptions, resolve, words_of
from orrery.plans.scratch import materialize

KINDS = ("email", "phone", "idno", "address", "name")
#: Most given names that are sent to the executors; a longer list is an error, not cut.
MOST_NAMES = 1_000_000

# ---------------------------------------------------------------- reading order

_GAP = re.compile(r"(?<=\S) {2,}(?=\S)")
_HYPHENS = "-¬\u00ad"


def _columns(xs: list[int]) -> list[int]:
    """The left edges of columns: places of lines apart by more than a column's ragged edge."""
    s = sorted(set(xs))
    return [x for k, x in enumerate(s) if not k or x - s[k - 1] > 250]


def _segments(text: str, boxes: dict[int, tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the printed pieces of lines, in reading order."""
    lines, a = [], 0
    for line in text.split("\n"):
        b = a + len(line)
        if line.strip():
            lines.append((a + len(line) - len(line.lstrip()), a + len(line.rstrip())))
        a = b + 1
    if boxes and len(lines) > 3:
        at = [boxes.get(s) or boxes.get(text.rfind("\n", 0, s) + 1) for s, _ in lines]
        known = [p for p in at if p]
        edges = _columns([x for x, _ in known])
        if len(edges) > 1 and len(known) > 0.8 * len(lines):
            col = [bisect_right(edges, p[0] + 100) if p else 0 for p in at]
            for k in range(1, len(col)):
                col[k] = col[k] or col[k - 1]
            if sum(b < a for a, b in zip(col, col[1:])) >= len(edges):
                return [lines[k] for k in sorted(range(len(lines)), key=lambda k: (col[k], k))]
    gaps = Counter()
    cut = []
    for s, e in lines:
        begin = text.rfind("\n", 0, s) + 1
        parts, p = [], s
        for m in _GAP.finditer(text, s, e):
            parts.append((p, m.start()))
            p = m.end()
            gaps[p - begin] += 1
        parts.append((p, e))
        cut.append((begin, parts))
    if gaps:
        top = max(gaps.values())
        if top >= 3 and top >= 0.25 * len(lines):
            edges = [0, *sorted(g for g, n in gaps.items() if n >= max(3, 0.5 * top))]
            out = []
            for k, (begin, parts) in enumerate(cut):
                for s, e in parts:
                    out.append((bisect_right(edges, s - begin), k, s, e))
            return [(s, e) for _, _, s, e in sorted(out)]
    return lines


def _flow(text: str, segments: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pieces with insertions read on their own: printed lines all in capitals that stand between others follow at the end, in their order, so that
    the text around them is read on. Nothing is left out. Lines that end like parts of sentences, or that a word runs into, are no insertions."""
    caps = []
    for k, (s, e) in enumerate(segments):
        x = text[s:e]
        alone = e - s > 7 and x.upper() == x and sum(map(str.isalpha, x)) * 2 > len(x) and not (x[-1] in ".,;:" + _HYPHENS or x[-1].isdigit())
        before = text[slice(*segments[k - 1])].split()[-1] if k else ""
        caps.append(alone and not (before[-1:] in _HYPHENS and before.upper() == before and len(before) > 2))
    first = next((k for k, c in enumerate(caps) if not c), len(caps))
    apart = [k for k in range(first, len(caps)) if caps[k]]
    if not apart:
        return segments
    return [x for k, x in enumerate(segments) if k < first or not caps[k]] + [segments[k] for k in apart]


def reading_order(text: str, boxes: dict[int, tuple[int, int]]) -> tuple[str, list[int], list[int]]:
    """The text as it is read, and where its pieces begin in it and in the page's text."""
    out: list[str] = []
    at, origin, n, last = [], [], 0, ""
    for s, e in _flow(text, _segments(text, boxes)):
        piece = text[s:e]
        if last:
            joint = last[-1]
            if joint in _HYPHENS and len(last) > 1:
                first = piece[0]
                if first == "-" and len(piece) > 1:
                    s, piece = s + 1, piece[1:]
                elif joint != "-" or first.islower():
                    out[-1] = last[:-1]
                    n -= 1
            else:
                out.append(" ")
                n += 1
        at.append(n)
        origin.append(s)
        out.append(piece)
        n += len(piece)
        last = piece
    return "".join(out), at, origin


# ---------------------------------------------------------------- rules

_D = "[0-9OolISB]"


def _digits(shape: str) -> str:
    """A pattern from a shape: 9 is a digit (perhaps misread), A a capital letter, _ an optional blank, other signs themselves."""
    out = ""
    for m in re.finditer(r"9+|.", shape):
        g = m[0]
        out += f"{_D}{{{len(g)}}}" if g[0] == "9" else "[A-Z]" if g == "A" else " ?" if g == "_" else " " if g == " " else re.escape(g)
    return out


#: How telephone numbers are grouped within countries.
PHONES = (
    "(999) 999-9999", "999-999-9999", "999.999.9999", "999 999 9999", "(999) 999 9999", "999-9999", "09999 999 999", "09999 999999", "099 9999 9999", "0999 999 9999", "0999/99999999", "099/99999999", "099 99999 999", "099 99999999",
    "0 99 / 9 99 99-999", "(0999) 9999 999", "(099) 9999 9999", "09 99 99 99 99", "09.99.99.99.99", "09-99-99-99-99", "0999 999999",
    "(99) 9999999", "99 999 99 99", "99-999-99-99", "999 99 99 99",
)
#: A number with a country's code: after + or 00, groups of digits with single separators and perhaps a trunk zero in brackets.
_WORLD = rf"(?:\+ ?|[0O][0O]){_D}{{1,3}}(?:(?:[ .-]|[ -]?\([0O]\) ?){_D}{{1,8}}){{1,5}}(?:-{_D}{{1,4}})?"
#: How numbers issued to persons are built: social security, insurance, identity card and passport numbers. AA is a pair of letters.
IDS = (
    "AA 99 99 99 A", "AA999999A", "999-99-9999", "999 99 9999", "9 99 99 99 999 999 99", "99 999999 A 999", "A9A999999", "AOA999999", "99AA99999", "A99999999", "AA9999999", "AA999999", "99999999-A", "99.999.999-A", "A-9999999-A", "99999999A",
)
#: Words before numbers of things.
THINGS = ("lot", "lots", "los", "lote", "order", "part", "stock", "teil", "bestellnummer", "commande", "pièce", "pedido", "pieza", "account", "konto", "compte", "cuenta", "circulation", "numbers", "saison", "season", "jahrgang", "temporada")
#: Words before telephone numbers.
CALLS = ("telephone", "bell", "day", "ring", "at", "fernruf", "tel", "tél", "teléfono", "au", "lessons", "maid", "phone")

_ID = re.compile(r"(?<![\w.,/-])(?:" + "|".join(map(_digits, IDS)) + r")(?![\w/-]|\.\d| \d{2}\b)")
_PHONE = re.compile(r"(?<![\w.,/+(-])(?<!\d )(?:" + _WORLD + "|" + "|".join(map(_digits, sorted(PHONES, key=len, reverse=True))) + r")(?![\w/]|[-.]\d| \d{2}\b(?! [A-Z]))")
_EXCHANGE = re.compile(rf"\b([A-ZÀ-Þ0][\w’-]+) ({_D}{{3,4}})(?=[.,;]? |[.,;]?$)")
#: Last parts of addresses, where a blank stands before them.
_TOP = r"(?:example|examp1e|test|tesf|invalid|inva1id|com|org|net|de|fr|es|uk)"
_AT = r"(?:[@©®]| ?[(\[] ?[a@][tf]? ?[)\]] ?)"
_EMAIL = re.compile(rf"(?<![\w.+-])[\w.+-]*\w(?:{_AT}[\w-]+(?:\.[\w-]+)*(?: ?\. ?{_TOP}\b|\.[A-Za-z]{{2,}})?| ?[@©®] ?[\w-]+(?:\.[\w-]+)*(?: ?\. ?{_TOP}\b|\.[A-Za-z]{{2,}})| [a@][tf] [\w-]+(?: d[o0][tf] [\w-]+)+)", re.I)
_AT_SIGN = re.compile(r"[@©®]|[(\[] ?[a@][tf]? ?[)\]]|(?<= )[a@][tf] [\w-]+ d[o0][tf] ", re.I)
_HOUSE = rf"(?:\d{_D}{{0,2}}|[OolISB]\d{_D}?)(?:[A-Za-z]\b|½| ?½)?"
_PROPER = r"[A-ZÀ-Þ0-9][\w’'-]*"
_EN_KIND = r"(?i:[s5ſ][tf]r?[ec]{1,2}[tf]|[s5ſ][tf]r[ec]+|[sſ5][tf]\.?|r[o0][aun]d|rd\.?|r[o0]w|[l1i][aun]n[ec]|[ec]r[ec][sſ5][ec]{2}n[tf]|[tf][ec]r{1,2}[aun][ec]{2}|[aun]v[ec]n[un][ec]|[aun]v[ec]\.?|[sſ5]qu[aun]r[ec]|Drive|Court|Place|Close|Gardens|Grove|Mews|Boulevard)"
_EN = re.compile(rf"(?<![\w./£$-])(?<!\d )({_HOUSE}),? (?:{_PROPER} ){{1,3}}?{_EN_KIND}(?![\w])")
_DE_KIND = r"(?:[sſ5][tf]r(?:[aun][ßsſB5]{1,2}e|[aun][ßsſB5]{1,2}[ce]|\.)|str(?:aße|asse)?|w[ec][g9]|g[aun][sſ5]{1,2}[ec]|p[l1i][aun][tf]z|[aun][l1i]{2}[ec]{2}|u[ft][ec]r|damm|ring|steig|markt)"
_DE = re.compile(rf"\b(?:(?:Ob[ec]r[ec]|Unt[ec]r[ec]|Alt[ec]|N[ec]u[ec]|Groß[ec]|Klein[ec]|Hint[ec]r[ec]|Vord[ec]r[ec]) )?[A-ZÄÖÜ][\w’-]{{2,}}?{_DE_KIND},? ?{_HOUSE}(?![\d,.]*\d)(?! ?(?:Mk|Uhr|Stimmen|Stunden))")
_FR_KIND = r"(?:ru[ec]|[aun]v[ec]n[un][ec]|[aun]v\.|b[o0]u[l1i][ec]v[aun]rd|bd\.?|qu[aun][il1]|p[l1i][aun][ce][ec]|impa[sſ5]{2}e|[il1]mp[aun][sſ5]{2}[ec]|ch[ec]min|all[ée]e|cours|passage|sentier)"
_FR = re.compile(rf"(?<![\w./-])(?<!\d )({_HOUSE}(?: (?:b[il1][sſ5]|t[ec]r))?),? {_FR_KIND} (?:(?:de la|d[ec] [l1i][aun]|d[un]|d[ec][sſ5]|aux|[aun]ux|d[ec] [l1i]?[’']?|d[’']) ?)?{_PROPER}", re.I)
#: Italian streets stand before their number, too.
_IT_KIND = r"(?:Via|Viale|Piazza|Corso|Vicolo|Largo)"
_ES_KIND = r"(?:C[aun][l1i]{2}[ec]|C/|Av[ec]n[il1]d[aun]|Avda\.?|Av\.|P[l1i][aun]z[aun]|Pza\.?|C[aun][l1i]{2}[ec]j[óo]n|P[aun][sſ5][ec][o0]|Ronda|Cuesta|Travesía|Camino)"
_ES = re.compile(rf"(?<![\w])(?:{_ES_KIND}|{_IT_KIND}) ?(?:(?:d[ec] [l1i][aun]|d[ec] [l1i][o0][sſ5]|d[ec][l1i]|d[ec]) )?(?:{_PROPER}(?: [A-ZÀ-Þ][\w’-]*){{0,2}}?),? ?(?:n[º°o]\.? ?|núm\.? ?)?{_HOUSE}(?![\d,.:]*\d)(?! ?(?:ptas|h\b|votos))")

#: Where a number may start: a digit, perhaps misread, a sign before it or the letters of a registry.
_START = re.compile(r"[0-9(+]|[OolISB][0-9]|[A-Z](?=[A-Z]?[ -]?[0-9OolISB])")


def _starts(t: str) -> list[int]:
    """Places where numbers may start: not within words or other numbers."""
    return [p for p in map(re.Match.start, _START.finditer(t)) if not p or not (t[p - 1].isalnum() or t[p - 1] == "_")]


def _matches(rule: re.Pattern, t: str, starts: list[int]) -> Iterator[re.Match]:
    """Matches of a rule at the starts, none within another."""
    end = 0
    for p in starts:
        if p >= end and (m := rule.match(t, p)):
            end = m.end()
            yield m


_THING_FOLDED = {folded(x) for x in THINGS}
_LONG_THINGS = {x for x in _THING_FOLDED if len(x) > 4}
_ABBREVIATIONS = {folded(x) for x in ("no", "nr", "nº", "n", "núm", "num", "nu", "m")}
_CALL_FOLDED = {folded(x) for x in CALLS}
#: Of these, those that stand right before the number.
_DIRECT = {folded(x) for x in ("bell", "day", "ring", "at", "au", "telephone", "fernruf", "teléfono", "phone")}


def _of_thing(t: str, at: int) -> bool:
    """Whether the words before a number say that it is that of a thing. The word may be broken by a blank."""
    words = [w for w in re.findall(r"[\w’]+", unicodedata.normalize("NFC", t[max(0, at - 30) : at])) if w]
    while words and len(words[-1]) < 4 and folded(words[-1]) in _ABBREVIATIONS:
        words.pop()
    if not words:
        return False
    return folded(words[-1]) in _THING_FOLDED or (len(words) > 1 and folded(words[-2] + words[-1]) in _LONG_THINGS)


def find(text: str, boxes: dict[int, tuple[int, int]], names: Names) -> list[tuple[str, int, int, str, list[tuple[int, int]]]]:
    """(kind, start, end, as read, pieces) of everything found in a page; start and pieces are places in text."""
    t, at, origin = reading_order(text, boxes)
    found: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def free(s: int, e: int) -> bool:
        p = bisect_right(taken, (s, 1 << 60))
        return not ((p and taken[p - 1][1] > s) or (p < len(taken) and taken[p][0] < e))

    def take(s: int, e: int, kind: str) -> None:
        if free(s, e):
            found.append((s, e, kind))
            taken.insert(bisect_right(taken, (s, e)), (s, e))

    done = 0
    for at_sign in _AT_SIGN.finditer(t):
        # Rules run around the signs only. The longest local part comes first, whatever its length.
        s = at_sign.start()
        while s > done and not t[s - 1].isspace():
            s -= 1
        while s > done and t[s - 1] == " " and t[s : at_sign.start()].strip() == "":
            s -= 1
            while s > done and not t[s - 1].isspace():
                s -= 1
        m = _EMAIL.search(t, s)
        if m and m.start() <= at_sign.start() < m.end():
            s, e = m.start(), m.end()
            done = e
            if re.fullmatch(r"[\d.,]+.*", m[0]) and not re.search(r"[a-z]{3}", m[0][:12], re.I):
                continue
            take(s, e, "email")
    starts = _starts(t)
    for m in _matches(_ID, t, starts):
        w = m[0]
        if sum(c.isdigit() for c in w) < 4:
            continue
        if not _of_thing(t, m.start()):
            take(m.start(), m.end(), "idno")
    for m in _matches(_PHONE, t, starts):
        if sum(c.isdigit() for c in m[0]) < 5:
            continue
        if not _of_thing(t, m.start()):
            take(m.start(), m.end(), "phone")
    for found_at in (_matches(_FR, t, starts), _ES.finditer(t), _DE.finditer(t), _matches(_EN, t, starts)):
        for m in found_at:
            take(m.start(), m.end(), "address")
    for m in _EXCHANGE.finditer(t):
        # Before an exchange word: a word that announces the number, or an address.
        s = m.start()
        lead, ls = word_before(t, s)
        words = [m[1]]
        while lead and lead[0].isupper() and len(lead) > 2 and folded(lead) not in _CALL_FOLDED and t[s - 1] == " " and t[s - 2].isalnum() and len(words) < 3 and free(ls, s):
            words.insert(0, lead)
            s = ls
            lead, ls = word_before(t, s)
        called = lead and folded(lead) in _CALL_FOLDED and (t[s - 2 : s - 1].isalnum() or folded(lead) not in _DIRECT)
        p = bisect_right(taken, (s, 0)) - 1
        beside = p >= 0 and taken[p][1] <= s and s - taken[p][1] <= 2 and t[taken[p][1] : s].strip() in (",", "") and any(x[:2] == taken[p] and x[2] == "address" for x in found)
        if (called or beside) and not re.match(r"(?:Lots|Between|Hymn|Lot|Circulation|Licence|Apply|Insurance|Nach|Seit|Zwischen|Mit|Depuis|Par|Desde|Por|Not|From|Rain|Members|Der|Die|Das|La|Le|El)\b", words[0]):
            take(s, m.end(), "phone")
    for s, e in find_names(t, names, taken):
        take(s, e, "name")
    out = []
    for s, e, kind in sorted(found):
        pieces = []
        k = bisect_right(at, s) - 1
        while k < len(at) and at[k] < e:
            a = max(s, at[k])
            b = min(e, at[k + 1] if k + 1 < len(at) else e)
            if b > a:
                pieces.append((origin[k] + a - at[k], origin[k] + b - at[k]))
            k += 1
        out.append((kind, pieces[0][0], pieces[-1][1], t[s:e], pieces))
    return out


def replaced(text: str, found: list, maker: Maker) -> str:
    """The text with <kind>surrogate</kind> for everything found; the rest is as it was. Pieces of one thing in other lines go."""
    cuts = []
    for kind, read, pieces in found:
        cuts.append((*pieces[0], f"<{kind}>{maker.make(kind, read)}</{kind}>"))
        cuts += [(a, b, "") for a, b in pieces[1:]]
    out, p = [], 0
    for a, b, new in sorted(cuts):
        if a >= p:
            out += [text[p:a], new]
            p = b
    return "".join(out) + text[p:]


# ---------------------------------------------------------------- over tables


def given_names(names: DataFrame, column: str = "given") -> tuple[str, ...]:
    """The list of given names, each once. It is a fixed list; one longer than MOST_NAMES raises."""
    got = [r[0] for r in names.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_NAMES + 1).collect()]
    if len(got) > MOST_NAMES:
        raise ValueError("the list of given names is too long to be sent to executors")
    return tuple(sorted(got))


def _pages(batches: Iterator[pa.RecordBatch], given: tuple[str, ...]) -> Iterator[tuple]:
    names = Names(given)
    for b in batches:
        lines = b.column("page_lines")
        for k, (i, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())):
            if not text or not text.strip():
                yield i, text, []
                continue
            boxes = {}
            if lines[k].is_valid:
                v = lines[k].values
                x0 = v.field("x0").to_pylist()
                if x0 and None not in x0 and max(x0) - min(x0) > 250:
                    boxes = {c: (x, y) for c, x, y in zip(v.field("c0").to_pylist(), x0, v.field("y0").to_pylist()) if c is not None}
            yield i, text, find(text, boxes, names)


def _documents(documents: DataFrame) -> DataFrame:
    lines = F.col("page_lines").cast("array<struct<c0:int,c1:int,x0:int,y0:int,x1:int,y1:int,conf:float>>")
    d = documents.select("doc_id", "text", F.transform(lines, lambda p: F.struct(p["c0"].alias("c0"), p["x0"].alias("x0"), p["y0"].alias("y0"))).alias("page_lines"))
    return d


def detect(documents: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos, found): every occurrence; start_pos is its first character in text, counted from 0.

    documents (doc_id, text, page_lines): without page_lines (null or empty) columns are told by their gaps only. Null, empty and blank texts have no rows; null or
    repeated doc_ids are kept as they are; further columns are ignored. Texts are read whole. found is the occurrence as it is read, without line ends.
    """
    given = given_names(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        pack = lambda r: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*r), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "kind", "start_pos", "end_pos", "found"])
        for i, _, found in _pages(batches, given):
            rows += [(i, kind, s, e, read) for kind, s, e, read, _ in found]
            if len(rows) > 20_000:
                yield pack(rows)
                rows = []
        if rows:
            yield pack(rows)

    return _documents(documents).mapInArrow(run, "doc_id bigint, kind string, start_pos bigint, end_pos bigint, found string")


_MARKED = "doc_id bigint, text string, found array<struct<kind:string,read:string,pieces:array<struct<a:int,b:int>>>>"


def marked(documents: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, text, found): each document, once more with what is found in it and where its pieces stand. Written to the shared folder, so that no text is searched twice."""
    given = given_names(names)
    piece = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("read", pa.string()), ("pieces", piece)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), kind))], names=["doc_id", "text", "found"])
        for i, text, found in _pages(batches, given):
            rows.append((i, text, [{"kind": k, "read": read, "pieces": [{"a": a, "b": b} for a, b in pieces]} for k, _, _, read, pieces in found]))
            size += len(text or "")
            if size > 4_000_000:
                yield pack()
                rows, size = [], 0
        if rows:
            yield pack()

    return materialize(_documents(documents).mapInArrow(run, _MARKED), "pii-marked")


def _words(found: DataFrame) -> DataFrame:
    return words_of(found.select(F.explode("found").alias("f")).select(F.col("f.kind").alias("kind"), F.col("f.read").alias("found")))


def pseudonymize(documents: DataFrame, names: DataFrame, key: str, syllables: int = 2) -> DataFrame:
    """(doc_id, text): the texts with everything found replaced by <kind>surrogate</kind>. One row comes out for each that goes in; null stays null.

    Words that would draw the surrogate of another word, or one that occurs, draw again, over the whole corpus: see surrogates.resolve().
    """
    found = marked(documents, names)
    known, secret = exceptions(*resolve(_words(found), key, syllables)), key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Maker(secret, known, syllables)
        for b in batches:
            for k in range(0, b.num_rows, 2_000):
                part = b.slice(k, 2_000)
                rows = zip(part.column("text").to_pylist(), part.column("found").to_pylist())
                texts = [replaced(t, [(f["kind"], f["read"], [(p["a"], p["b"]) for p in f["pieces"]]) for f in fs], maker) if fs else t for t, fs in rows]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return found.mapInArrow(run, "doc_id bigint, text string")


def collisions(documents: DataFrame, names: DataFrame, key: str, syllables: int = 2) -> DataFrame:
    """(pool, words, drawn_again, own_spellings, still_colliding): per pool of surrogates the words in it (those that look the same count once), how many had to draw
    again as their surrogate was another's or occurs itself, how many spellings are words of their own, and how many surrogates stand for several words, which is 0."""
    drawn, own = resolve(_words(marked(documents, names)), key, syllables)
    n = drawn.groupBy("pool").agg(F.count("*").alias("words"), F.sum((F.col("attempt") > 0).cast("bigint")).alias("drawn_again"), (F.count("*") - F.countDistinct("surrogate")).alias("still_colliding"))
    o = own.groupBy("pool").agg(F.count("*").alias("own_spellings"))
    return n.join(o, "pool", "left").select("pool", "words", "drawn_again", F.coalesce("own_spellings", F.lit(0)).alias("own_spellings"), "still_colliding")
