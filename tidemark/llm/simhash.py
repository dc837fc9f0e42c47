"""SimHash near-duplicates, linked through Golay-code keys."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import golay
from tidemark.llm.common import boxed, checkpointed, fields, lasting, read, scratch
from tidemark.llm.components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
LONG_TEXT = 4_000_000  # bytes beyond which words are streamed instead of listed
BLOCK = 50_000  # shingles whose bits are counted at once
#: Bits of the three segments of a fingerprint; the last is short and counts as padded with zeros.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Buckets up to this size are compared pair by pair; larger ones are linked through one-bit neighbourhoods.
PAIRWISE = 32

#: keep_one: words of a shingle, and the similarity (a fraction) of shingle sets from which texts are near copies.
WIDTH, LEAST = 5, (4, 5)
#: Bands of minima and minima of a band: texts of similarity 0.8 share no band with a chance of 0.0006, of 0.9 of 6e-10.
BANDS, ROWS = 40, 8
#: Of the BANDS * ROWS bits of two sketches, (1 - similarity) / 2 differ: 32 of 320 at 0.8, and 59 is five standard errors more.
MAX_APART = 59
#: Texts that each text of a bucket is compared with in each round, before the pairs that are left, and texts of a block
#: in which these are compared.
TRIES, BLOCK_TEXTS = (1, 8, 16), 64
FACTORS, SUMMANDS = np.random.default_rng(42).integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32)
FACTORS |= np.uint32(1)
SKETCH = [f"s{i}" for i in range(BANDS * ROWS // 64)]


def _shingles(raw: bytes, width: int) -> Iterator[list[int]]:
    """Blocks of XXH64 values (seed 42) of all shingles."""
    h = xxhash.xxh64_intdigest
    if len(raw) <= LONG_TEXT:
        words = raw.split()
        if not words:
            return
        flat = b" ".join(words)
        if len(words) <= width:
            yield [h(flat, 42)]
            return
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-width]]).tolist()
        ends = (ends[width - 1 :] - 1).tolist()
        for i in range(0, len(starts), BLOCK):
            yield [h(flat[a:b], 42) for a, b in zip(starts[i : i + BLOCK], ends[i : i + BLOCK])]
        return
    window, out, seen = [], [], False
    for m in WORD.finditer(raw):
        window.append(m[0])
        if len(window) > width:
            window.pop(0)
        if len(window) == width:
            out.append(h(b" ".join(window), 42))
            seen = True
        if len(out) >= BLOCK:
            yield out
            out = []
    if not seen and window:
        out.append(h(b" ".join(window), 42))
    if out:
        yield out


def _counted(block: list[int]) -> np.ndarray:
    """How many hashes of a block have each bit set."""
    bits = np.unpackbits(np.array(block, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _majority(total: np.ndarray, n: int) -> int:
    packed = np.packbits(total * 2 > n, bitorder="little") if n else np.zeros(8, np.uint8)
    return int(packed.view("<i8")[0])


def simhash(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint, as a signed long; 0 for a text without words."""
    total, n = np.zeros(64, dtype=np.int64), 0
    for block in _shingles((text or "").encode().lower(), width):  # bytes.lower changes A-Z only
        total += _counted(block)
        n += len(block)
    return _majority(total, n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id long, fp long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key for each segment i and each nearby codeword of the next: i, the segment as it is, the codeword's index."""
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo in range(0, len(fps), 20_000):
            part = fps[lo : lo + 20_000]
            segments = [part.view(np.uint64) >> np.uint64(a) & np.uint64((1 << n) - 1) for a, n in SEGMENTS]
            segments = [s.astype(np.int64) for s in segments]
            for i, exact in enumerate(segments):
                at, code = golay.nearby(segments[(i + 1) % len(segments)])
                key = (np.int64(i) << 35) | (exact[at] << 12) | code
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[at])], ["key", "fp"])


def _balls(fp: str = "fp") -> str:
    return f"concat(array({fp}), transform(sequence(0, 63), i -> {fp} ^ shiftleft(1L, i)))"


def links(fps: DataFrame) -> DataFrame:
    """fps (fp long, distinct) -> links (a, b) that join exactly the groups reachable in steps of at most two bits.

    Of at most two differing bits over three segments, at least one segment has none (pigeonhole) and the next has
    at most two, so some key of _keyed is shared: the exact segment and a common nearby codeword. Buckets of up
    to PAIRWISE fingerprints are compared pair by pair. The members of larger buckets are instead grouped by all words
    within one bit of them: two fingerprints are at most two bits apart if and only if they share such a word, no word
    has more than 65 fingerprints, and one link to the smallest of these keeps them together. So no pair is lost
    and no bucket is expanded into its pairs.
    """
    keyed = checkpointed(fps.select("fp").mapInArrow(_keyed, "key long, fp long"))
    sizes = checkpointed(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = checkpointed(keyed.join(sizes, "key"))
    light = shared.filter(F.col("n") <= PAIRWISE)
    pairs = (
        light.select("key", F.col("fp").alias("a"))
        .join(light.select("key", F.col("fp").alias("b")), "key")
        .filter("a < b and bit_count(a ^ b) <= 2")
        .select("a", "b")
    )
    heavy = shared.filter(F.col("n") > PAIRWISE).select("fp").distinct()
    stars = (
        heavy.select("fp", F.explode(F.expr(_balls())).alias("word"))
        .groupBy("word")
        .agg(F.collect_list("fp").alias("fps"))  # at most 65
        .filter(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .filter("a <> b")
    )
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id.

    Words are runs without ASCII white space of the text with A-Z lower-cased; a fingerprint's bit is set if it is set
    in over half of the hashes of the shingles, repeats included. Equal texts have equal fingerprints and are
    linked before any key is made, however many there are. Null and empty texts have fingerprint 0 and are linked to each
    other (and to others within two bits). Whole texts are read, very long ones word by word. A row without id stays, with
    the smallest id of its group, or null if none has one; ids that repeat stay as often as they came. An empty table has
    no rows. Other columns of docs are not looked at.
    """
    with scratch(docs.sparkSession):
        rows = checkpointed(fingerprints(docs, id_col, text_col, width))
        fps = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
        parts = checkpointed(connected_components(links(fps)))
        joined = fps.join(parts, fps.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
        joined = checkpointed(joined)
        ids = joined.groupBy("part").agg(F.min("least").alias("component_id"))
        named = checkpointed(joined.join(checkpointed(ids), "part").select("fp", "component_id"))
        return lasting(rows.join(named, "fp").select("doc_id", "fp", "component_id"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns for every document: doc_id, fingerprint, component_id."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sketched(text: str | None, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """The least value of each of BANDS * ROWS hash functions over the shingles (the largest value without words), and the
    fingerprint of the shingles."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    total, n = np.zeros(64, dtype=np.int64), 0
    for block in _shingles((text or "").encode().lower(), width):
        total += _counted(block)
        n += len(block)
        values = np.unique(np.array(block, dtype=np.uint64).astype(np.uint32))
        for lo in range(0, len(values), 256):
            hashed = values[lo : lo + 256, None] * FACTORS + SUMMANDS
            np.minimum(least, hashed.min(axis=0), out=least)
    return least, _majority(total, n)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tid, text -> tid, the fingerprint, the keys of the bands, and a sketch of one bit for each minimum."""
    for batch in batches:
        fps, keys, bits = [], [], []
        for text in batch.column(1):
            least, fp = sketched(text.as_py())
            fps.append(fp)
            keys.append([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))])
            bits.append(np.packbits(least & 1, bitorder="little").view("<i8"))
        keys = pa.array(np.array(keys, dtype=np.uint64).view(np.int64).reshape(-1))
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * BANDS), keys)
        sketch = np.array(bits, dtype=np.int64).reshape(-1, len(SKETCH)).T
        columns = [batch.column(0), pa.array(fps, pa.int64()), keys, *[pa.array(np.ascontiguousarray(c)) for c in sketch]]
        yield pa.RecordBatch.from_arrays(columns, ["tid", "fp", "keys", *SKETCH])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tid, text -> tid, the sorted distinct shingles as bytes."""
    for batch in batches:
        found = []
        for text in batch.column(1):
            blocks = [np.array(b, dtype="<u8") for b in _shingles((text.as_py() or "").encode().lower(), WIDTH)]
            found.append(np.unique(np.concatenate(blocks)).tobytes() if blocks else b"")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["tid", "shingles"])


def similar(a: bytes, b: bytes) -> bool:
    """Whether two sets of _sets have a Jaccard similarity of LEAST or more; empty sets are alike."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * LEAST[1] >= (len(x) + len(y) - both) * LEAST[0]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [similar(a.as_py(), b.as_py()) for a, b in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _alike(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of texts (tid, text) whose shingle sets are similar. Only texts in pairs are moved."""
    wanted = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("tid")).distinct())
    sets = texts.join(wanted, "tid", "left_semi").dropDuplicates(["tid"]).mapInArrow(_sets, "tid long, shingles binary")
    sets = checkpointed(sets)
    left = sets.select(F.col("tid").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("tid").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
    return checkpointed(both.mapInArrow(_verified, "a long, b long"))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two lists of (tid, part, shingles) a row -> the pairs between them that are similar and of different parts."""
    for batch in batches:
        out: list[tuple[int, int]] = []
        for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets = [np.frombuffer(x["shingles"], "<u8") for x in left]
            sizes, parts = np.array([len(s) for s in sets]), np.array([x["part"] for x in left])
            values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            for y in right:
                other = np.frombuffer(y["shingles"], "<u8")
                # how many of its shingles each text of the left has, all at once
                at = np.minimum(np.searchsorted(other, values), max(len(other) - 1, 0))
                both = np.bincount(owner[other[at] == values], minlength=len(sets)) if len(other) else np.zeros(len(sets), int)
                like = (both * LEAST[1] >= (sizes + len(other) - both) * LEAST[0]) & (parts != y["part"])
                out += [(min(left[i]["tid"], y["tid"]), max(left[i]["tid"], y["tid"])) for i in np.nonzero(like)[0]]
        a, b = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _across(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """The links (a, b) between texts (tid, text) of different parts in the same bucket; placed: (key, tid, part).

    The texts of a bucket are packed to blocks, and each block meets each other one of its bucket, so that pairs are
    compared within a task and only links come out of it.
    """
    mixed = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    mixed = checkpointed(mixed.select("key", F.ceil(F.col("n") / BLOCK_TEXTS).alias("blocks")))
    rows = checkpointed(placed.join(mixed, "key"))
    wanted = checkpointed(rows.select("tid").distinct())
    sets = texts.join(wanted, "tid", "left_semi").dropDuplicates(["tid"]).mapInArrow(_sets, "tid long, shingles binary")
    block = F.pmod(F.xxhash64("tid", F.lit(7)), F.col("blocks")).alias("block")
    met = rows.select("key", "tid", "part", block).join(checkpointed(sets), "tid")
    # some BLOCK_TEXTS texts a list
    packed = checkpointed(met.groupBy("key", "block").agg(F.collect_list(F.struct("tid", "part", "shingles")).alias("items")))
    left = packed.select("key", F.col("block").alias("l"), F.col("items").alias("l_items"))
    right = packed.select("key", F.col("block").alias("r"), F.col("items").alias("r_items"))
    pairs = left.join(right, "key").filter("l <= r").select("l_items", "r_items")
    return checkpointed(pairs.mapInArrow(_linked, "a long, b long").filter("a < b").distinct())


def text_hash(text: Column) -> Column:
    """64 bits that stand for a text (null counts as empty) where links are made."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def near_copies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(tid, part): each distinct text of docs by its text_hash, and the smallest tid of the texts that it is linked to
    over any number of links. Texts are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8
    or more; texts without words (and null) are alike.

    Candidates come in three steps, and every link is verified on the shingles themselves. First, texts whose fingerprints
    `links` joins through Golay-code keys. At 0.8 fingerprints differ in some ten of 64 bits, more than such keys can
    bridge, so the others share a band of minima. Second, in rounds, a text is verified against some texts of other
    components in its buckets (TRIES): that settles even a large group in which a pair in twenty is alike with some tens of
    pairs a text. Third, in buckets whose texts still are in several components, texts of different ones are compared in
    blocks. So no pair that shares a band and could join two components is left out, whatever the size of its bucket, and no
    bucket is expanded into its pairs.
    """
    with scratch(docs.sparkSession):
        return lasting(_near_copies(docs, text_col))


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """nodes (tid, fp) -> pairs (a, b), a < b: texts of equal fingerprints with the smallest one, and the smallest ones of
    fingerprints that are linked."""
    first = checkpointed(nodes.groupBy("fp").agg(F.min("tid").alias("lead")))
    same = nodes.join(first, "fp").filter("tid <> lead").select(F.col("lead").alias("a"), F.col("tid").alias("b"))
    near = checkpointed(links(first.select("fp")))
    ends = [first.select(F.col("fp").alias(c), F.col("lead").alias(f"lead_{c}")) for c in ("a", "b")]
    other = near.join(ends[0], "a").join(ends[1], "b").select(F.least("lead_a", "lead_b").alias("a"), F.greatest("lead_a", "lead_b").alias("b"))
    return checkpointed(same.unionByName(other).distinct())


def _near_copies(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(text_hash(F.col(text_col)).alias("tid"), text.alias("text"))
    rows = texts.mapInArrow(_banded, f"tid long, fp long, keys array<long>, {', '.join(f'{s} long' for s in SKETCH)}")
    nodes = checkpointed(rows.dropDuplicates(["tid"]))
    keyed = nodes.select("tid", F.explode("keys").alias("key"))
    leads = keyed.groupBy("key").agg(F.min("tid").alias("lead"), F.max("tid").alias("last")).filter("lead < last")
    shared = checkpointed(keyed.join(checkpointed(leads.select("key")), "key"))
    sketches = checkpointed(nodes.select("tid", *SKETCH).join(shared.select("tid").distinct(), "tid", "left_semi"))

    def sketch(side: str) -> DataFrame:
        return sketches.select(F.col("tid").alias(side), *[F.col(s).alias(f"{side}_{s}") for s in SKETCH])

    near = " + ".join(f"bit_count(a_{s} ^ b_{s})" for s in SKETCH) + f" <= {MAX_APART}"
    found = _alike(texts, _by_fingerprint(nodes.select("tid", "fp")))
    parts = checkpointed(connected_components(found))
    placed = checkpointed(shared.join(parts, F.col("tid") == F.col("node"), "left").select("key", "tid", F.coalesce("component", "tid").alias("part")))
    for turn, tries in enumerate(TRIES):
        # in each bucket of several components, some texts by a hash: those that the others try
        lead = lambda j: F.min(F.struct(F.xxhash64("tid", F.lit(64 * turn + j)).alias("h"), "tid", "part")).alias(f"lead{j}")  # noqa: E731, B023
        leads = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), *[lead(j) for j in range(tries)])
        leads = checkpointed(leads.filter("lo < hi").drop("lo", "hi"))
        if leads.isEmpty():
            break
        placed = checkpointed(placed.join(leads.select("key"), "key", "left_semi"))  # buckets of one component are done
        # of each, a text tries the one of the bucket that a hash chooses
        own = lambda j: F.struct(F.xxhash64("key", F.lit(j)).alias("h"), f"lead{j}.tid", f"lead{j}.part")
        chosen = [F.min(F.when(F.col("part") != F.col(f"lead{j}.part"), own(j))).alias(f"x{j}") for j in range(tries)]
        asked = placed.join(leads, "key").groupBy("tid", "part").agg(*chosen)
        every = F.array_distinct(F.filter(F.array(*[F.when(F.col(f"x{j}").isNotNull(), F.struct(f"x{j}.tid", f"x{j}.part")) for j in range(tries)]), F.isnotnull))
        stars = asked.select(F.col("tid").alias("b"), F.col("part").alias("v"), F.explode(every).alias("x")).select(F.col("x.tid").alias("a"), "b", F.col("x.part").alias("u"), "v")
        stars = checkpointed(stars.join(sketch("a"), "a").join(sketch("b"), "b").filter(near).select("a", "b", "u", "v"))
        alike = _alike(texts, stars.select("a", "b"))
        merged = checkpointed(connected_components(stars.join(alike, ["a", "b"]).select(F.col("u").alias("a"), F.col("v").alias("b"))))
        placed = placed.join(merged, F.col("part") == F.col("node"), "left")
        placed = checkpointed(placed.select("key", "tid", F.coalesce("component", "part").alias("part")))
        found = found.unionByName(alike)
    found = found.unionByName(_across(texts, placed))
    parts = checkpointed(connected_components(found))
    return nodes.select("tid").join(parts, F.col("tid") == F.col("node"), "left").select("tid", F.coalesce("component", "tid").alias("part"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, in their own columns, without near copies: of each group of rows whose texts near_copies links, one stays.

    That is the row with the smallest doc_id (rows without come last), then with the smallest text_hash, then with the
    smallest JSON text. Rows that share an id but not their texts are judged by their texts alone: none goes for its id.
    Null and empty texts are a group. Very long texts are compared as a whole; an empty table stays empty; columns of
    other names pass as they are. Texts are told apart by text_hash; of n distinct texts some n^2 / 2^65 pairs share one.
    """
    parts = near_copies(docs)
    ids, text = F.col("doc_id").cast("long"), text_hash(F.col("text"))
    rows = docs.select(ids.alias("id"), text.alias("tid")).groupBy("tid", "id").agg(F.count("*").alias("n"))
    # each text's first row, then that of each group; n tells how many rows share both id and text
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("tid"), F.col("n"))
    first = rows.groupBy("tid").agg(F.min(order).alias("first"))
    best = first.join(parts, "tid").groupBy("part").agg(F.min("first").alias("first"))
    best = checkpointed(best.select(F.col("first.tid").alias("tid"), F.col("first.id").alias("id"), F.col("first.n").alias("n")))

    def chosen(which: str, **more: Column) -> DataFrame:
        left, right = boxed(docs, tid=text, id=ids, **more).alias("l"), best.filter(which).alias("r")
        return left.join(right, (F.col("l.tid") == F.col("r.tid")) & F.col("l.id").eqNullSafe(F.col("r.id")), "left_semi")

    single = chosen("n = 1").select("row.*")
    if best.filter("n > 1").isEmpty():
        return single
    others = F.to_json(F.struct(*[c for c, name in zip(fields(docs), docs.columns) if name != "text"]))
    first = F.row_number().over(Window.partitionBy("tid", "id").orderBy("others"))
    return single.unionByName(chosen("n > 1", others=others).withColumn("first", first).filter("first = 1").select("row.*"))
