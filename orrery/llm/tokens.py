"""Encoding of whole corpora with a public byte-level BPE tokenizer, by Spark's higher-order functions.

Texts are cut into words by the tokenizer's pattern. Words that are tokens as a whole are looked up at once. All others are encoded once per
distinct word of the corpus, folding the ranked merges over the word's bytes, and put back: a fixed number of the most frequent ones by a literal, the
rest by a join on the word; within a document each of them counts once. The ranks are a literal of the plan: buckets of small maps, as long as the vocabulary, whose size is fixed.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orrery.plans.scratch import materialize

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Unicode's white space, which Java's \s doesn't name. The pattern is that of the tokenizer's public description.
_S = r"\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf" ?\p{{L}}++| ?\p{{N}}++|'s|'t|'re|'ve|'m|'ll|'d| ?[^{_S}\p{{L}}\p{{N}}]++|[{_S}]+(?![^{_S}])|[{_S}]+"
_BUCKETS = 16384
#: The most frequent words of the corpus that are no tokens: so many, each of at most so many characters, are put back by a literal of a megabyte at most instead of the
#: join, which also takes the skew out of it. All others, the long ones too, are joined.
FREQUENT, FREQUENT_LENGTH = 4096, 64


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the vocabulary files are: ORRERY_TOKENIZERS, else the installed package of public tokenizers."""
    folder = os.environ.get("ORRERY_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _literal(entries: dict, keys: dict[str, bytes], kind: str = "int") -> Column:
    """array<map<string,kind>>: entries by the checksum of their bytes. It is folded to one literal when the plan is optimized."""
    buckets: list[dict] = [{} for _ in range(_BUCKETS)]
    for k, n in entries.items():
        buckets[zlib.crc32(keys[k]) % _BUCKETS][k] = n
    return F.from_json(F.lit(json.dumps(buckets)), f"array<map<string,{kind}>>")


def _words(path: str) -> Column:
    """Ranks of the tokens that are texts, by text."""
    out, keys = {}, {}
    for b, n in ranks(path).items():
        try:
            t = b.decode("utf-8")
        except UnicodeDecodeError:
            continue
        out[t], keys[t] = n, b
    return _literal(out, keys)


def _pieces(path: str) -> Column:
    """Ranks of all tokens, by their bytes in hexadecimal."""
    r = ranks(path)
    return _literal({b.hex().upper(): n for b, n in r.items()}, {b.hex().upper(): b for b in r})


def _rank(table: Column, piece: Column) -> Column:
    return table[(F.crc32(piece) % _BUCKETS).cast("int")][F.hex(piece)]


def merge(word: Column, path: str) -> Column:
    """The ids of a word that is no token: ranked merges folded over its bytes, the lowest rank first, of equal ones the leftmost."""

    def encode(table: Column) -> Column:
        b = word.cast("binary")
        first = F.transform(F.sequence(F.lit(1), F.octet_length(b)), lambda i: F.substring(b, i, F.lit(1)))
        pairs = lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: _rank(table, F.concat(F.get(p, i), F.get(p, i + 1))))

        def step(s: Column, _: Column) -> Column:
            p, r = s["p"], s["r"]
            low = F.array_min(r)
            at = F.array_position(r, low).cast("int")  # of pieces at and at + 1, from 1
            both = F.concat(F.get(p, at - 1), F.get(p, at))
            p2 = F.concat(F.slice(p, 1, at - 1), F.array(both), F.slice(p, at + 2, F.size(p)))
            left = F.when(at > 1, F.array(_rank(table, F.concat(F.get(p, at - 2), both)))).otherwise(F.array().cast("array<int>"))
            right = F.when(at + 1 < F.size(p), F.array(_rank(table, F.concat(both, F.get(p, at + 1))))).otherwise(F.array().cast("array<int>"))
            r2 = F.concat(F.slice(r, 1, F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(r)))
            return F.when(low.isNull(), s).otherwise(F.struct(p2.alias("p"), r2.alias("r")))

        start = F.transform(F.array(first), lambda p: F.struct(p.alias("p"), pairs(p).alias("r")))[0]
        done = F.aggregate(F.sequence(F.lit(2), F.octet_length(b)), start, step)
        return F.transform(done["p"], lambda p: _rank(table, p))

    return F.transform(F.array(_pieces(path)), encode)[0]


def encode(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids ARRAY<INT>): the ids of each text, without special tokens.

    Null and empty texts have the empty list; a text of blanks has the ids of its blanks. One row comes out for each row that goes in, also for null
    and repeated keys; further columns are ignored. Whole texts are encoded; strings of special tokens are ordinary text. A word of n bytes that is no
    token takes n steps over lists of at most n pieces.
    """
    path = path or vocabulary_path()
    d = documents.select(F.col(key).alias("k"), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PATTERN), F.lit(0)).alias("w"))
    look = lambda t: lambda w: t[(F.crc32(w.cast("binary")) % _BUCKETS).cast("int")][w]
    d = d.withColumn("r", F.transform(F.array(_words(path)), lambda t: F.transform(F.col("w"), look(t)))[0])
    d = d.withColumn("o", F.array_distinct(F.array_compact(F.zip_with("w", "r", lambda w, r: F.when(r.isNull(), w)))))
    known = F.zip_with("w", "r", lambda w, r: F.coalesce(r, -F.array_position(F.col("o"), w).cast("int")))
    # Ids, or minus the place of a word among the document's other words.
    d = materialize(d.select(F.monotonically_increasing_id().alias("row"), "k", known.alias("c"), "o"), "tokens")
    other = d.where(F.size("o") > 0).select("row", F.posexplode("o").alias("at", "w"))
    book = other.groupBy("w").agg(F.count("*").alias("n"))
    book = materialize(book.select("w", "n", merge(F.col("w"), path).alias("ids")), "token-book")
    # A fixed number of words of bounded length; all others are joined.
    frequent = {r["w"]: list(r["ids"]) for r in book.where(F.length("w") <= FREQUENT_LENGTH).orderBy(F.desc("n"), "w").limit(FREQUENT).collect()}
    table = _literal(frequent, {w: w.encode() for w in frequent}, "array<int>")
    rare = other.withColumn("f", F.transform(F.array(table), lambda t: look(t)(F.col("w")))[0]).where(F.col("f").isNull()).drop("f")
    found = rare.join(book.select("w", "ids"), "w").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "ids"))).alias("m"))
    joined = d.join(found, "row", "left")
    full = F.transform(F.array(table), lambda t: F.transform("o", lambda w, at: F.coalesce(look(t)(w), F.try_element_at("m", at))))[0]
    # Bound to a variable, so that it is worked out once per document and not per word.
    ids = F.transform(F.array(full), lambda f: F.flatten(F.transform("c", lambda c: F.when(c >= 0, F.array(c)).otherwise(F.get(f, -c - 1)))))[0]
    return joined.select(F.col("k").alias(key), ids.alias("ids"))


def decode(encoded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the texts of lists of ids, by joining their binary pieces. A null list gives null, the empty one the empty text; ids that don't exist give null."""
    r = ranks(path or vocabulary_path())
    by_id = [""] * (max(r.values()) + 1)
    for b, n in r.items():
        by_id[n] = b.hex()
    table = F.from_json(F.lit(json.dumps(by_id)), "array<string>")
    joined = F.transform(F.array(table), lambda t: F.array_join(F.transform(F.col(ids), lambda i: F.when((i >= 0) & (i < len(by_id)), F.get(t, i)).otherwise("?")), ""))[0]
    return encoded.select(F.col(key), F.expr("1").alias("one"), joined.alias("hex")).select(key, F.when(~F.col("hex").contains("?"), F.unhex("hex")).cast("string").alias("text"))


def token_counts(documents: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """documents with n_tokens BIGINT, the number of ids of the text (0 for null and empty ones; a column of that name is replaced), counted batch by batch with the tokenizer's library."""
    documents = documents.drop("n_tokens")
    path = path or vocabulary_path()
    table = ranks(path)
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    schema = StructType([*documents.schema.fields, StructField("n_tokens", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        codec = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        for b in batches:
            n = [len(codec.encode_ordinary(t)) if t else 0 for t in b.column(text).to_pylist()]
            yield b.append_column("n_tokens", pa.array(n, pa.int64()))

    return documents.mapInArrow(count, schema)
