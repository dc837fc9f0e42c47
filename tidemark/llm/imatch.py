"""Document fingerprints by I-Match with randomised lexicons."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, read

TERM = re.compile(r"[^\W_]+")
#: The band of document frequency (as a share of all documents) of lexicon terms: not the rarest, not the commonest.
RAREST, COMMONEST = 0.0005, 0.05
#: Lexicon subsets: each rate keeps its share of the lexicon, several times with other random draws. Subsets with many
#: terms change with any edit, subsets with few survive larger ones.
RATES, DRAWS = (2 / 3, 1 / 3, 1 / 12, 1 / 48, 1 / 128, 1 / 256, 1 / 512, 1 / 1024), 8
EMPTY, NO_WHOLE = "0000", "00000000"
#: Terms whose place in the lexicon is kept by a task.
KNOWN = 400_000
#: Lexicon terms up to which the lexicon is broadcast (64 bytes each); a larger one is joined by term. The band alone bounds
#: them: at most (distinct terms per document) / RAREST.
BROADCAST_TERMS = 4_000_000
FLUSH = 400_000


def term_hash(term: str) -> int:
    """64 bits, as a signed long."""
    value = xxhash.xxh64_intdigest(term.encode(), 11)
    return value - (1 << 64) if value >> 63 else value


def terms(text: str) -> set[str]:
    return set(TERM.findall(text.lower()))


def frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term long, df long): in how many rows of docs each term occurs, by the term's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = pa.array([term_hash(t) for t in counts], pa.int64())
            out = pa.RecordBatch.from_arrays([keys, pa.array(list(counts.values()), pa.int64())], ["term", "df"])
            counts.clear()
            return out

        for batch in batches:
            for x in batch.column(0):
                counts.update(terms(x.as_py() or ""))
                if len(counts) > FLUSH:
                    yield flush()
        if counts:
            yield flush()

    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def member(keys: np.ndarray) -> np.ndarray:
    """The subsets (one bit each) that each term (by its hash) is in: the splitmix64 of the term and the draw's number is
    compared with the draw's rate."""
    base, found = keys.astype(np.int64).view(np.uint64), np.zeros(len(keys), dtype=np.uint64)
    for k, rate in enumerate(np.repeat(RATES, DRAWS)):
        z = base + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        inside = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) < np.uint64(int(rate * (1 << 53)))
        found |= inside.astype(np.uint64) << np.uint64(k)
    return found


def whole_hash(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:8] if found else NO_WHOLE


def subset_hashes(keys: np.ndarray, subsets: np.ndarray) -> list[str]:
    """Four hex digits of each subset's terms, of a document's lexicon terms (sorted hashes) and the subsets they are in."""
    out = [EMPTY] * (len(RATES) * DRAWS)
    # one row for each subset; its terms stand together, in order
    inside = np.unpackbits(subsets.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    subset, term = np.divmod(np.flatnonzero(inside), max(len(keys), 1))
    raw, ends = keys[term].tobytes(), np.cumsum(np.bincount(subset, minlength=len(out))) * 8
    at = 0
    for k, end in enumerate(ends.tolist()):
        if end > at:
            out[k] = f"{xxhash.xxh64_intdigest(raw[at:end]) % 0xFFFF + 1:04x}"
            at = end
    return out


class Lexicon:
    """Terms of the band, and the subsets that each of them is in."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.member = member(self.keys)
        self.place: dict[str, int] = {}

    def __reduce__(self):
        return Lexicon, (self.keys,)

    def know(self, found: set[str]) -> None:
        """Afterwards `place` has these terms: where they stand in keys, -1 for those beyond the lexicon."""
        if len(self.place) > KNOWN:
            self.place = {}
        new = list(found.difference(self.place))
        hashes = np.fromiter(map(term_hash, new), np.int64, len(new))
        at = np.searchsorted(self.keys, hashes)
        there = self.keys[np.minimum(at, len(self.keys) - 1)] == hashes if len(self.keys) else np.zeros(len(new), bool)
        self.place.update(zip(new, np.where(there, at, -1).tolist()))

    def fingerprint(self, text: str) -> list[str]:
        """subset_hashes of the text's terms (EMPTY for none), and for a text without terms of the lexicon a hash of all its
        terms. Terms count once, in the order of their hashes."""
        found = terms(text)
        self.know(found)
        at = np.fromiter(map(self.place.__getitem__, found), dtype=np.int64, count=len(found))
        at = np.unique(at[at >= 0])  # two terms may share a hash
        return [*subset_hashes(self.keys[at], self.member[at]), NO_WHOLE if len(at) else whole_hash(found)]


def likeness(a: list[str], b: list[str]) -> float:
    """The share of equal subsets among those in which one of two texts has terms. If neither text has a term of the
    lexicon: 1 if all their terms are the same, else 0."""
    used = [(x, y) for x, y in zip(a[:-1], b[:-1]) if x != EMPTY or y != EMPTY]
    if not used:
        return float(a[-1] == b[-1])
    return sum(x == y for x, y in used) / len(used)


def band(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term long): the lexicon of all rows of docs."""
    total = docs.count()
    least, most = max(2, math.ceil(RAREST * total)), math.floor(COMMONEST * total)
    return frequencies(docs, text_col).filter(F.col("df").between(least, most)).select("term")


def lexicon(docs: DataFrame, text_col: str = "text") -> Lexicon | DataFrame:
    """The lexicon, for a broadcast if it has at most BROADCAST_TERMS terms, else as a table. Only terms of the band come
    to the driver."""
    table = checkpointed(band(docs, text_col))
    if table.count() > BROADCAST_TERMS:
        return table
    return Lexicon(table.toArrow().column("term").to_numpy().astype(np.int64))


TERMS = "array<long>"


def joined(rows: DataFrame, table: DataFrame, names: list[str]) -> DataFrame:
    """rows with each array of term hashes in `names` (distinct, sorted) restricted to the terms of table.

    Arrays are exploded and joined by term; a term in a third of all rows is beyond the band, and its rows are
    split by Spark as for any skewed key. What is gathered again are the terms of one row.
    """
    rows = checkpointed(rows.withColumn("at", F.monotonically_increasing_id()))
    for name in names:
        each = rows.select("at", F.explode(name).alias("term"))
        kept = each.join(table, "term").groupBy("at").agg(F.sort_array(F.collect_list("term")).alias("kept"))
        rows = rows.join(kept, "at", "left").withColumn(name, F.coalesce("kept", F.array().cast(TERMS))).drop("kept")
    return rows.drop("at")


def hashed(found: set[str]) -> list[int]:
    return sorted({term_hash(t) for t in found})


def joined_fingerprint(keys, whole: str) -> list[str]:
    """As Lexicon.fingerprint, from a row's terms that are in the lexicon."""
    keys = np.array(keys, dtype=np.int64)
    return [*subset_hashes(keys, member(keys)), NO_WHOLE if len(keys) else whole]


def fingerprints(docs: DataFrame, words: Lexicon | DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint), one row per row of docs. Null texts count as empty, and all texts without terms have the
    same fingerprint; equal texts have equal fingerprints, also where ids repeat or are missing. Whole texts are read,
    however long; an empty table has no rows; other columns are not looked at."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if isinstance(words, Lexicon):
        shared = docs.sparkSession.sparkContext.broadcast(words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = ["".join(shared.value.fingerprint(x.as_py() or "")) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

        return rows.mapInArrow(run, "doc_id long, fingerprint string")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(x.as_py() or "") for x in batch.column(1)]
            columns = [pa.array([hashed(f) for f in found], pa.list_(pa.int64())), pa.array([whole_hash(f) for f in found])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "mine", "whole"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ["".join(joined_fingerprint(k, w)) for k, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    rows = joined(rows.mapInArrow(split, f"doc_id long, mine {TERMS}, whole string"), words, ["mine"])
    return rows.select("doc_id", "mine", "whole").mapInArrow(finish, "doc_id long, fingerprint string")


FIRST = -(1 << 63)  # the place of rows without id: before all others


def dealt(docs: DataFrame, per_bucket: int = 1000, most: int = 200_000) -> DataFrame:
    """(bucket int, guest boolean, doc_id, h, text): docs dealt to buckets that are ranges of (doc_id, h), where h is a hash of
    the text, each with a copy of the first row of the bucket after it (of the first bucket, after the last) as a guest.

    Texts move once. The bounds of the buckets come from a sample of ids and hashes, some twenty a bucket; only these
    come to the driver. Rows that repeat an id are split by their texts. A bucket of more rows than memory holds is
    sorted on disk.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    place = F.coalesce("doc_id", F.lit(FIRST))
    n = docs.count()
    buckets = max(1, min(most, n // per_bucket))
    cuts: list[tuple[int, int]] = []
    if buckets > 1:
        every = max(1, n // (20 * buckets))
        seen = rows.filter(F.pmod(F.xxhash64("doc_id", "h"), F.lit(every)) == 0).select(place.alias("k"), "h").toArrow()
        seen = sorted(set(zip(seen.column("k").to_pylist(), seen.column("h").to_pylist())))
        cuts = seen[20::20] if every > 1 else seen[per_bucket::per_bucket]
    keys, hashes = (np.array(x, dtype=np.int64) for x in (zip(*cuts) if cuts else ((), ())))

    @F.pandas_udf("int")
    def bucket_of(k: pd.Series, h: pd.Series) -> pd.Series:
        low, high = (np.searchsorted(keys, k.to_numpy(), side) for side in ("left", "right"))
        for i in np.nonzero(high > low)[0]:  # ids that are a bound: the hash decides
            low[i] += np.searchsorted(hashes[low[i] : high[i]], h.iat[i], "right")
        return pd.Series(low.astype(np.int32))

    bucket = bucket_of(place, "h") if cuts else F.lit(0)
    placed = rows.select(bucket.alias("bucket"), F.lit(False).alias("guest"), "doc_id", "h", "text")
    least = rows.agg(F.min(place)).first()[0]
    if least is None:
        return placed
    # the bounds are rows themselves, the first ones of their buckets; that of the first bucket has the least id
    before = [(i, k, h) for i, (k, h) in enumerate(cuts)] + [(len(cuts), least, None)]
    guests = docs.sparkSession.createDataFrame(before, "to int, k long, of long")
    met = rows.join(F.broadcast(guests), (place == F.col("k")) & F.coalesce(F.col("of") == F.col("h"), F.lit(True)))
    first = met.groupBy("to").agg(F.min(F.struct("h", "doc_id", "text")).alias("x"))
    copies = first.select(F.col("to").alias("bucket"), F.lit(True).alias("guest"), "x.doc_id", "x.h", "x.text")
    return placed.unionByName(copies)


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """(doc_id, text, the following row's text) of the rows of dealt, sorted."""
    held = None
    for batch in batches:
        for guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            if guest and held is None:
                continue  # the bucket's rows are done
            if held is not None:
                yield held[0], held[1], text
            held = None if guest else (doc_id, text)


def rows_of(found: Iterator[tuple], schema: str, size: int = 200) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), TERMS: pa.list_(pa.int64())}
    names, types = zip(*(f.split() for f in schema.split(", ")))
    while some := list(itertools.islice(found, size)):
        yield pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, t in zip(zip(*some), types)], list(names))


def compare(docs: DataFrame, words: Lexicon | DataFrame) -> DataFrame:
    """RESULT for every row of docs, from it and the row after it by doc_id (rows without id come first, rows that share an
    id go by the hashes of their texts; the first row follows the last).

    Null texts count as empty. Rows that repeat stay, each beside the next. Whole texts are read, however long; a single
    row is its own next; an empty table has no rows; other columns are not looked at.
    """
    rows = dealt(docs).repartition("bucket").sortWithinPartitions("bucket", "guest", F.coalesce("doc_id", F.lit(FIRST)), "h")
    rows = rows.select("bucket", "guest", "doc_id", "text")
    if isinstance(words, Lexicon):
        shared = docs.sparkSession.sparkContext.broadcast(words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def found() -> Iterator[tuple]:
                words, last = shared.value, (None, None)
                for doc_id, text, following in pairs(batches):
                    mine = last[1] if last[0] is text else words.fingerprint(text)
                    changed = edited(text, following)
                    other, last = words.fingerprint(changed), (following, words.fingerprint(following))
                    sha = hashlib.sha256(changed.encode()).hexdigest()
                    yield doc_id, len(text), sha, "".join(mine), "".join(other), likeness(mine, other), likeness(mine, last[1])

            return rows_of(found(), RESULT)

        return rows.mapInArrow(run, RESULT)

    sets = [f"{x} {TERMS}, {x}_whole string" for x in ("mine", "other", "following")]
    first = ", ".join(["doc_id long, n_chars long, edited_sha256 string", *sets])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for doc_id, text, following in pairs(batches):
                changed = edited(text, following)
                three = [terms(x) for x in (text, changed, following)]
                yield doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), *(x for t in three for x in (hashed(t), whole_hash(t)))

        return rows_of(found(), first)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, n, sha, *x in zip(*(c.to_pylist() for c in batch.columns)):
                    mine, other, following = (joined_fingerprint(*x[i : i + 2]) for i in (0, 2, 4))
                    yield doc_id, n, sha, "".join(mine), "".join(other), likeness(mine, other), likeness(mine, following)

        return rows_of(found(), RESULT)

    restricted = joined(rows.mapInArrow(split, first), words, ["mine", "other", "following"])
    return restricted.select(*[f.split()[0] for f in first.split(", ")]).mapInArrow(finish, RESULT)


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns for every document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return compare(docs, lexicon(docs))
