"""Names of persons in running text, by an open vocabulary: what a name is follows from its parts and what stands around it.

A given name is known from a list, from the endings that the list itself shows to be productive, or from the common ones below; signs that scans mistake
for each other count as equal. A family name is any word with a capital letter in the place of one: after a given name, initials or a title, before a
comma and a given name, or before a given name that nothing follows. Words of firms, ships, streets and places before or after it say that it is none.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

#: Common given names of English, German, French and Spanish, of women and of men.
WOMEN = (
    "Alice Amelia Anna Anne Barbara Bertha Caroline Catherine Charlotte Clara Dorothy Edith Eleanor Elizabeth Emily Emma Ethel Florence Grace Harriet Helen Jane Julia Laura Louise Lucy Margaret Martha Mary Nora Rose Ruth Sarah Susan "
    "Elisabeth Elsa Frieda Gertrud Greta Hedwig Hilde Ingrid Johanna Katharina Luise Margarete Maria Marie Mathilde Renate Sabine Ursula Amélie Céline Claire Élise Geneviève Hélène Isabelle Jeanne Madeleine Marguerite Simone Sophie Suzanne Thérèse Yvonne "
    "Ana Beatriz Carmen Concepción Dolores Elena Inés Isabel Josefa Juana Lucía Luisa Manuela Mercedes Pilar Rosa Teresa"
).split()
MEN = (
    "Albert Alfred Andrew Arthur Charles Daniel David Edward Ernest Francis Frank Frederick George Harold Harry Henry Hugh Jack James John Joseph Michael Oliver Patrick Peter Philip Ralph Richard Robert Samuel Stephen Thomas Walter William "
    "Anton August Emil Ernst Franz Friedrich Fritz Georg Gustav Hans Heinrich Hermann Jakob Johann Josef Karl Klaus Kurt Ludwig Otto Paul Rudolf Stefan Wilhelm Alain André Antoine Claude Émile Étienne François Gaston Guillaume Henri Jacques Jean Jules Louis Marcel Michel Pierre René "
    "Alberto Antonio Carlos Diego Fernando Francisco Javier José Juan Luis Manuel Miguel Pablo Pedro Rafael Ramón"
).split()
#: Titles before a name; of women, of men, of either.
TITLES_F = "mrs miss ms lady frau fräulein witwe mme mlle madame mademoiselle veuve viuda doña señora señorita sra srta".split()
TITLES_M = "mr sir lord herr monsieur don señor sr".split()
TITLES_X = "dr prof professor captain capt colonel col major lieutenant lieut general constable sergeant inspector judge rev reverend wachtmeister hauptmann doktor docteur maître doctor capitán".split()
TITLES = (*TITLES_F, *TITLES_M, *TITLES_X)
#: Words after the name of a firm, a ship, a street or a place, and words before one.
NOT_AFTER = (
    "& savings bank company co ltd inc corp gmbh ag cie cía bros brothers sons söhne fils hijos freres hermanos hotel castle queen king star stern étoile estrella collieries colliery horses works mills school church college hall house station "
    "heath cross bridge street st road rd row lane crescent terrace avenue ave square drive court place close gardens grove mews boulevard quay park theatre"
).split()
NOT_BEFORE = (
    "messrs firm firma house haus maison casa brig steamer schooner barque ship ss hms schiff dampfer navire vapeur barco vapor street straße rue avenue quai place boulevard impasse chemin calle plaza avenida paseo callejón "
    "san santa santo saint sainte sankt st puerto port porto villa bad mount lake monte"
).split()
#: Words that are no family names though they begin with a capital letter: articles, pronouns, prepositions, conjunctions, places' first words, offices, days and months.
NO_FAMILY = (
    "the a an and or but of in on at to by for from with it its is was were be he she they we you his her this that these those there then when where who what which while under over after before not no so as if all any each both such "
    "der die das den dem des ein eine einen und oder aber von vom im in am an auf zu zum zur mit nach bei aus für seit über unter es er sie wir ihr ist war wird werden nicht kein keine als wenn wo wer was so sein seine "
    "c’est c'est était fue era war said le la les un une et ou mais de du des en au aux à dans sur par pour avec sans il elle on nous vous ils ce cette ces son sa est sont qui que où ne pas depuis selon après avant entre "
    "el los las uno una unos y o pero del al con sin por para según tras desde hasta entre él ella ellos se su sus es son fue que quien donde no "
    "san santa santo saint sainte sankt st puerto port bad groß klein upper lower north south east west old new speaker president chairman mayor neue neuer neues neuen nueva nuevo nouveau nouvelle whether "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december"
).split()
PARTICLES = ("van der", "van den", "van", "von der", "von", "de la", "de los", "de las", "del", "des", "de", "du", "della", "di", "da", "zu", "zur", "der", "ten")

_FOLD = str.maketrans({"1": "i", "l": "i", "|": "i", "!": "i", "0": "o", "5": "s", "9": "g", "8": "b", "ſ": "s", "c": "e", "u": "n", "a": "n", "r": "n", "h": "b", "f": "t", "ø": "o", "ß": "b", "6": "b"})
_FOLDS: dict[str, str] = {}
#: Most words that a cache keeps.
CACHE = 500_000


def folded(word: str) -> str:
    """A word with signs that scans mistake for each other made equal."""
    got = _FOLDS.get(word)
    if got is None:
        if len(_FOLDS) > CACHE:
            _FOLDS.clear()
        got = _FOLDS[word] = _fold(word)
    return got


def _fold(word: str) -> str:
    w = unicodedata.normalize("NFKD", word.lower().replace("ſ", "s").replace("ø", "o"))
    w = "".join(c for c in w if not unicodedata.combining(c))
    for a, b in (("rn", "m"), ("ri", "n"), ("rl", "n"), ("r1", "n"), ("vv", "w"), ("ii", "u")):
        w = w.replace(a, b)
    return w.translate(_FOLD)


def _less(w: str) -> set[str]:
    return {w[:k] + w[k + 1 :] for k in range(len(w))}


def endings(listed: set[str], heads: int = 6, ends: int = 3) -> tuple[set[str], set[str]]:
    """(heads, ends): the endings of two to six letters that at least so many heads of a list take, and the heads that take at least so many of these."""
    of_end: dict[str, set[str]] = defaultdict(set)
    for g in listed:
        for k in range(2, 7):
            if len(g) - k >= 2:
                of_end[g[-k:]].add(g[:-k])
    while True:
        of_head: dict[str, int] = defaultdict(int)
        for hs in of_end.values():
            for h in hs:
                of_head[h] += 1
        good = {h for h, n in of_head.items() if n >= ends}
        left = {e: hs & good for e, hs in of_end.items() if len(hs & good) >= heads}
        if left == of_end:
            return good, set(left)
        of_end = left


class Names:
    """Tells given names, also misread ones, from other words."""

    def __init__(self, given: tuple[str, ...] = ()):
        listed = {g.strip().title() for g in given if g and g.strip()}
        heads, ends = endings(listed)
        self.listed = listed
        own = {folded(w) for w in listed | {h + e for h in heads for e in ends}}
        self.given = own | {folded(w) for w in (*WOMEN, *MEN)}
        # The short common names are near to too many words to be found with a letter more, less or changed.
        self.own, self.less = own, {x for w in own if len(w) > 4 for x in _less(w)}
        self.ends = {w[k:] for w in self.given for k in range(1, len(w) - 1)}
        self.known: dict[str, str] = {}

    def is_given(self, word: str) -> str:
        """'G' for a given name, 'g' for a word that is near to one, else ''."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > CACHE:
                self.known.clear()
            got = self.known[word] = self._is_given(word)
        return got

    def _is_given(self, word: str) -> str:
        if "-" in word.strip("-"):
            parts = [self.is_given(p) for p in word.split("-") if p]
            return max(parts) if all(parts) else self.is_given(word.replace("-", ""))
        w = folded(word)
        if word.lower() in _NO_FAMILY or w in _AFTER or (is_title(word) and word.title() not in self.listed):
            return ""
        if w in self.given:
            return "G"
        # Lines in capitals hold all kinds of words.
        if len(w) < (7 if word.upper() == word else 5):
            return ""
        near = _less(w)
        return "g" if w in self.less or near & self.own or (len(w) > 5 and near & self.less) else ""

    def broken(self, head: str, tail: str) -> bool:
        """Whether a given name has been broken into two by a blank."""
        return len(tail) < 9 and len(head) + len(tail) > 4 and folded(tail) in self.ends and not self.is_given(tail) and folded(head + tail) in self.given


_TOKEN = re.compile(r"[A-ZÀ-ÞΑ-ΩА-Я0-9ſ][\w’ſ]*(?:-[A-ZÀ-ÞΑ-ΩА-Я0-9][\w’ſ]*)*|l(?=[bcdfghkld])\w+")
_WORD = re.compile(r"[\w’&-]+")
_TITLE = {folded(x) for x in TITLES}
_PLAIN_TITLE = set(TITLES)
#: Titles that are written small.
_SMALL_TITLES = {folded(x) for x in ("don", "doña", "señor", "señora", "señorita", "madame", "mademoiselle", "monsieur", "veuve", "viuda", "docteur", "maître")}
_AFTER = {folded(x) for x in NOT_AFTER}
_BEFORE = {folded(x) for x in NOT_BEFORE}
_NO_FAMILY = set(NO_FAMILY)
_OFFICES = {folded(x) for x in ("speaker", "president", "chairman", "secretary", "treasurer")}
_SMALL = {x for x in NO_FAMILY if len(x) > 1}
_FOLDED_SMALL = {folded(x) for x in _SMALL}


def word_before(t: str, at: int) -> tuple[str, int]:
    """The word that ends before a place (without its point), and where it starts."""
    e = at
    while e > 0 and not (t[e - 1].isalnum()):
        if at - e > 2:
            return "", e
        e -= 1
    s = e
    while s > 0 and (t[s - 1].isalnum() or t[s - 1] in "’ſ"):
        s -= 1
    return t[s:e], s


def is_title(word: str) -> bool:
    """Whether a word is a title, perhaps misread."""
    low = word.lower()
    return low in _PLAIN_TITLE or (len(word) > 1 and low not in _SMALL and folded(word) in _TITLE)


def _is_family(w: str) -> bool:
    """Whether a word has the shape of a family name."""
    low = w.lower()
    if len(w) < 2 or low in _NO_FAMILY or folded(w) in _AFTER or folded(w) in _OFFICES or is_title(w):
        return False
    letters = sum(c.isalpha() for c in w)
    return letters >= 2 and letters * 2 > len(w)


class _Page:
    """The words of a text that may be parts of names."""

    def __init__(self, t: str, names: Names):
        self.t, self.names = t, names
        self.tokens: list[tuple[int, int, str]] = []
        for m in _TOKEN.finditer(t):
            w, s, e = m[0], m.start(), m.end()
            if w[0].isdigit() and not (len(w) > 3 and w[1:2].isalpha()):
                continue
            if len(w) == 1:
                if w.isupper() and t[e : e + 2] == ". ":
                    self.tokens.append((s, e, "I"))
                continue
            kind = names.is_given(w) if len(w) > 2 else ""
            if not kind and e + 1 < len(t) and t[e] == " " and t[e + 1].islower():
                n = _WORD.match(t, e + 1)
                if n and names.broken(w, n[0]):
                    kind, e = "G", n.end()
            self.tokens.append((s, e, kind or ("F" if _is_family(w) else "")))
        self.at = {s: k for k, (s, _, _) in enumerate(self.tokens)}

    def family(self, p: int, caps: bool | None = None, exact: bool = False) -> int | None:
        """Where the family name ends that starts at p, perhaps with a particle; caps: whether all its letters have to be capital ones; exact: whether it follows a
        given name that is no guess, so that its first letter may have been misread as a digit."""
        t = self.t
        for q in PARTICLES:
            if t.startswith(q, p) and t[p + len(q) : p + len(q) + 1] == " ":
                p += len(q) + 1
                break
        k = self.at.get(p)
        if k is None or self.tokens[k][2] not in ("F", "G", "g"):
            return None
        s, e, kind = self.tokens[k]
        w = t[s:e]
        if len(w) < 3 and caps is None or w[0].islower() or (w[0].isdigit() and not exact):
            return None
        if caps is not None and caps != (w.upper() == w) and len(w) > 2:
            return None
        return e if kind == "F" or _is_family(w) else None

    def beyond(self, e: int, given: bool) -> int | None:
        """The place after a given name or initials where a family name may start: after further initials, and given names if so asked."""
        t = self.t
        for _ in range(3):
            if t[e : e + 1] != " ":
                return None
            k = self.at.get(e + 1)
            if k is not None and self.tokens[k][2] == "I":
                e = self.tokens[k][1] + 1
            elif k is not None and given and self.tokens[k][2] in ("G", "g") and self.family_after(self.tokens[k][1], t[self.tokens[k][0] : self.tokens[k][1]]):
                e = self.tokens[k][1]
            else:
                return e + 1
        return e + 1 if t[e : e + 1] == " " else None

    def family_after(self, e: int, word: str) -> int | None:
        """Where a family name ends that follows a given name directly."""
        return self.family(e + 1, word.upper() == word and len(word) > 1) if self.t[e : e + 1] == " " else None

    def person(self, start: int, end: int) -> bool:
        """Whether nothing around says that this is a firm, a ship, a street or a place."""
        t = self.t
        n = _WORD.match(t, end + 1) if t[end : end + 1] == " " else None
        if n and folded(n[0]) in _AFTER and (n[0] == "&" or n[0][0].isupper() or n[0].lower() in ("horses",)):
            return False
        b = word_before(t, start)[0]
        return not (b and folded(b) in _BEFORE and t[start - 1 : start] == " " and t[start - 2 : start - 1] != ".")

    def full(self, i: int) -> int | None:
        """Where the name ends that starts with the given name or the initials at i and ends with a family name."""
        s, e, kind = self.tokens[i]
        word = self.t[s:e]
        p = self.beyond(e + 1 if kind == "I" else e, kind != "I")
        if p is None:
            return None
        return self.family(p, word.upper() == word if kind != "I" else None, kind == "G")

    def name(self, i: int) -> tuple[int, int] | None:
        t, (s, e, kind) = self.t, self.tokens[i]
        if not kind:
            return None
        if kind == "I":
            end = self.full(i)
            if not end or not self.person(s, end):
                return None
            if t[s] == "M" and re.match(r" et M(?:me|[ll]le)|, Mme", t[end : end + 8]):
                first = t.index(" ", s) + 1
                return first, end
            return s, end
        if kind in ("G", "g"):
            end = self.full(i)
            if end:
                return (s, end) if self.person(s, end) else None
        before, b = word_before(t, s)
        word = t[s:e]
        caps = word.upper() == word
        if e - s < 3 or not self.person(s, e):
            return None
        # A family name and, after a comma, a given name or an initial that no family name follows.
        if t[e : e + 2] == ", " and kind != "G" and (k := self.at.get(e + 2)) is not None and not self._goes_on(s, before, b):
            s2, e2, k2 = self.tokens[k]
            if k2 in ("I", "G", "g") and (t[s - 2 : s] == "— " or not self.full(k)) and (k2 == "I" or caps == (t[s2:e2].upper() == t[s2:e2])):
                return s, e2 + (k2 == "I")
        # After a title, a family name alone.
        start = s
        for q in PARTICLES:
            if t.endswith(" " + q + " ", 0, s):
                start = s - len(q) - 1
                break
        w, at = word_before(t, start)
        if w and t[at + len(w) : start] in (" ", ". ") and is_title(w) and (w[0].isupper() if w.upper() != w or len(w) < 5 else not caps) | (folded(w) in _SMALL_TITLES) and (kind == "F" or _is_family(word)):
            return start, e
        # A family name before a given name that no family name follows.
        if kind in ("F", "g") and t[e : e + 1] == " " and (k := self.at.get(e + 1)) is not None and self.tokens[k][2] == "G" and not self.full(k):
            s2, e2, _ = self.tokens[k]
            if t[s2].isupper() and folded(word) not in _FOLDED_SMALL and caps == (t[s2:e2].upper() == t[s2:e2]) and self.person(s, e2):
                return s, e2
        return None

    def _goes_on(self, s: int, before: str, b: int) -> bool:
        """Whether the word before s belongs to the word at s, as in the names of places."""
        k = self.at.get(b)
        return bool(before) and k is not None and self.t[b + len(before) : s] == " " and self.tokens[k][2] in ("F", "G", "g")


def find_names(t: str, names: Names, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the names in a text, in its order, outside of what is taken (sorted)."""
    page, end = _Page(t, names), 0
    for i, (s, _, _) in enumerate(page.tokens):
        if s < end:
            continue
        got = page.name(i)
        if got:
            p = bisect_right(taken, (got[0], 1 << 60)) - 1
            if (p >= 0 and taken[p][1] > got[0]) or (p + 1 < len(taken) and taken[p + 1][0] < got[1]):
                continue
            end = got[1]
            yield got
