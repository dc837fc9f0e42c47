"""Collocations: phrases whose words stand together more often than apart, counted by automata over candidates from sketches."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, lasting, read, release, scratch

#: Words of a phrase at most, and occurrences that make it a candidate.
WORDS, LEAST = 4, 30
#: Percent of a candidate's occurrences that lie within one longer phrase and so make it a part of that.
WITHIN = 80
#: Phrases that a language keeps.
TOP = 2000

#: Bytes of text for each cell of a sketch, and the powers of two that bound its cells: a set of heavy cells, one bit each,
#: goes to every worker, so it has at most 128 MB.
BYTES_PER_CELL, FEWEST, MOST = 24, 16, 30
#: Cells of a sketch's block; a partial sketch travels block by block.
BLOCK = 1 << 16
#: Occurrences that a task gathers before it sends partial counts.
GATHERED = 3_000_000
#: Candidates that a task remembers so as to tell them once.
TOLD = 500_000
#: Phrases of one automaton.
SHARD = 300_000
#: Counts that travel together from a task: nearly all tasks have nearly all phrases, so counts without names take least room.
COUNTS = 1 << 12
#: Bytes of text that are looked at together.
CHUNK = 1 << 20

#: A-Z to lower case, tab to space, the ends of pieces to a line feed. UTF-8 has these bytes nowhere else.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
_MASK = (1 << 64) - 1
_FACTOR = 0x9E3779B97F4A7C15


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """(bytes, ahead): folded texts, some of them together, parted by line feeds; a long one in several parts.

    A part is cut at the end of a piece where there is one, else between words; it then goes on with the first words of the next
    part. `ahead` says how many, so that phrases across the cut are found once, by their first word.
    """
    held, total = [], 0
    for text in texts:
        text = text.translate(_FOLD)
        if len(text) < size:
            held.append(text)
            total += len(text)
            if total >= size:
                yield b"\n".join(held), 0
                held, total = [], 0
        else:
            yield from _parts(text, size)
    if held:
        yield b"\n".join(held), 0


def _end(text: bytes, at: int) -> int:
    """Where the word that stands at `at` ends."""
    return min((x for x in (text.find(b" ", at), text.find(b"\n", at)) if x >= 0), default=len(text))


def _parts(text: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    at = 0
    while at < len(text):
        end = text.rfind(b"\n", at + 1, at + size) if at + size < len(text) else len(text)
        if end < 0:
            end = _end(text, at + size)
        words, spot = [], end
        while text[spot : spot + 1] == b" " and len(words) < WORDS - 1:
            stop = _end(text, spot + 1)
            words += [text[spot + 1 : stop]] if stop > spot + 1 else []
            spot = stop
        yield b" ".join([text[at:end], *words]), len(words)
        at = end


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        up = np.full(n, _FACTOR | 1, np.uint64)
        up[0] = 1
        down = np.full(n, pow(_FACTOR | 1, -1, 1 << 64), np.uint64)
        down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a chunk: where they are, in which piece, and the hashes of their phrases."""

    def __init__(self, chunk: bytes, ahead: int, lang: int):
        data = np.frombuffer(chunk, np.uint8)
        inside = (data != 32) & (data != 10)
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.chunk, self.starts, self.ends = chunk, edge[::2], edge[1::2]
        self.n, self.fresh = len(self.starts), max(0, len(self.starts) - ahead)
        self.new = np.arange(self.n) < self.fresh
        self.piece = np.cumsum(data == 10, dtype=np.int32)[self.starts]
        up, down = _powers(1 << max(20, len(data).bit_length()))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        word = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        self.word = _mixed(word ^ np.uint64(lang))

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, new) of the phrase of k words from each word on (the last k - 1 have none); new: within a piece and not
        counted in the next chunk."""
        n = max(0, self.n - k + 1)
        found = self.word[:n]
        for i in range(1, k):
            found = _mixed(found * np.uint64(_FACTOR) + self.word[i : n + i])
        return found, (self.piece[:n] == self.piece[k - 1 :][:n]) & self.new[:n]

    def likely(self, pairs: np.ndarray, power: int) -> np.ndarray:
        """From which words on a pair within a piece is heavy."""
        found, _ = self.phrases(2)
        return _heavy(pairs, found >> np.uint64(64 - power)) & (self.piece[:-1] == self.piece[1:]) if len(found) else np.zeros(0, bool)

    def text(self, i: int, k: int) -> str:
        return b" ".join(w for w in self.chunk[self.starts[i] : self.ends[i + k - 1]].split(b" ") if w).decode()


def _lang_hash(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 11)


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The texts of a batch (lang, text) by language, as bytes."""
    held: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
        held.setdefault(lang, []).append(text.as_py())
    yield from held.items()


def _heavy(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _likely(words: Words, pairs: np.ndarray | None, power: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(k, hash, new) of the phrases that a sketch counts: pairs, or, where heavy pairs are known, what is longer and has no
    other pairs (a phrase is no more frequent than any part of it)."""
    found, new = words.phrases(2)
    if pairs is None:
        return [(2, found, new)]
    good = words.likely(pairs, power)
    out = []
    for k in range(3, WORDS + 1):
        found, new = words.phrases(k)
        for i in range(k - 1):
            new = new & good[i : i + len(new)]
        out.append((k, found, new))
    return out


class Sketch:
    """Counts of hashed cells on their way: gathered, then given out by block as places and counts of a byte, 255 at most."""

    def __init__(self, power: int):
        self.power, self.held, self.size = power, [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.held.append((hashes >> np.uint64(64 - self.power)).astype(np.uint32))
        self.size += len(hashes)

    def given(self) -> Iterator[tuple[int, bytes]]:
        if not self.size:
            return
        cells, counts = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.size = [], 0
        places, counts = (cells & np.uint32(BLOCK - 1)).astype("<u2"), np.minimum(counts, 255).astype(np.uint8)
        blocks = cells >> np.uint32(16)
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)]):
            yield int(blocks[a]), places[a:b].tobytes() + counts[a:b].tobytes()


def heavy_cells(rows: DataFrame, power: int, least: int, pairs=None) -> tuple[np.ndarray, DataFrame]:
    """(bits, words): the cells of a sketch of rows (lang, text) that count `least` occurrences or more, as bits; and (lang, n) of
    the words of parts of the rows.

    pairs: a broadcast of the heavy pairs, for a sketch of longer phrases. Tasks send partial sketches by block; these are
    summed block by block as they come. The bits have at most 2^MOST cells, whatever the size of the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, known, totals = Sketch(power), pairs.value if pairs is not None else None, Counter()

        def sent() -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for row in sketch.given():
                held.append(row)
                size += len(row[1])
                if size >= 1 << 22:
                    yield _sketch_rows(held)
                    held, size = [], 0
            if held:
                yield _sketch_rows(held)

        for batch in batches:
            for lang, texts in _by_language(batch):
                key = _lang_hash(lang)
                for chunk, ahead in chunks(texts):
                    words = Words(chunk, ahead, key)
                    totals[lang] += words.fresh
                    for _, found, new in _likely(words, known, power):
                        sketch.add(found[new])
                    if sketch.size >= GATHERED:
                        yield from sent()
        yield from sent()
        release()
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1] * len(totals), pa.int32()), pa.array([None] * len(totals), pa.binary()), pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())],
            ["block", "data", "lang", "n"],
        )

    sent = checkpointed(rows.mapInArrow(run, "block int, data binary, lang string, n long"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                n = len(data) // 3
                cells = sums.setdefault(block, np.zeros(BLOCK, np.uint8))
                places = np.frombuffer(data, "<u2", n)
                cells[places] = np.minimum(cells[places].astype(np.uint16) + np.frombuffer(data, np.uint8, n, 2 * n), 255)
        for block, cells in sums.items():
            bits = np.packbits(cells >= least, bitorder="little")
            if bits.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["block", "bits"])

    parts = sent.filter("block >= 0").select("block", "data").repartition("block").mapInArrow(summed, "block int, bits binary")
    bits = np.zeros(max(1, (1 << power) >> 3), np.uint8)
    for row in parts.collect():
        at = row["block"] * (BLOCK >> 3)
        bits[at : at + (BLOCK >> 3)] = np.frombuffer(row["bits"], np.uint8)
    return bits, sent.filter("block < 0").groupBy("lang").agg(F.sum("n").alias("n"))


def _sketch_rows(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
    none = len(held)
    arrays = [pa.array([b for b, _ in held], pa.int32()), pa.array([d for _, d in held], pa.binary()), pa.nulls(none, pa.string()), pa.nulls(none, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["block", "data", "lang", "n"])


def _shard(pairs: np.ndarray, shards: int) -> np.ndarray:
    """The shard of phrases that begin with pairs of these hashes (other bits than those of a sketch's cells)."""
    return ((pairs & np.uint64(0xFFFFFFFF)) % np.uint64(shards)).astype(np.int64)


def routed(rows: DataFrame, power: int, pairs, shards: int) -> DataFrame:
    """(shard, lang, windows): the places of rows (lang, text) where a phrase may begin, one window a line, blocks of them a row.

    A window is up to WORDS words from a heavy pair on, as far as pairs are heavy: all phrases that begin there lie in it. It goes
    to the shard of its first pair, so each shard looks at its own windows only, and a frequent pair makes more blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], list[bytes]] = {}
        sizes: Counter = Counter()

        def given(keys: list[tuple[int, str]]) -> pa.RecordBatch:
            blocks = [b"\n".join(held.pop(k)) for k in keys]
            for k in keys:
                sizes.pop(k)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array(blocks, pa.binary())], ["shard", "lang", "windows"])

        for batch in batches:
            for lang, texts in _by_language(batch):
                key = _lang_hash(lang)
                for chunk, ahead in chunks(texts):
                    words = Words(chunk, ahead, key)
                    likely = words.likely(pairs.value, power)
                    at = np.flatnonzero(likely & words.new[: len(likely)])
                    if not len(at):
                        continue
                    # the last word of each window: on while pairs are heavy
                    last, goes_on = at + 1, np.ones(len(at), bool)
                    padded = np.concatenate([likely, np.zeros(WORDS, bool)])
                    for i in range(1, WORDS - 1):
                        goes_on &= padded[at + i]
                        last = last + goes_on
                    to = _shard(words.phrases(2)[0][at], shards)
                    order = np.argsort(to, kind="stable")
                    cut = [chunk[a:b] for a, b in zip(words.starts[at[order]].tolist(), words.ends[last[order]].tolist())]
                    bounds = np.searchsorted(to[order], np.arange(shards + 1)).tolist()
                    for s in np.unique(to).tolist():
                        part = cut[bounds[s] : bounds[s + 1]]
                        held.setdefault((s, lang), []).extend(part)
                        sizes[s, lang] += sum(map(len, part))
                    if full := [k for k, n in sizes.items() if n >= CHUNK]:
                        yield given(full)
                    elif sum(sizes.values()) >= 32 * CHUNK:  # many shards, none of them full
                        yield given(list(sizes))
        release()
        if held:
            yield given(list(sizes))

    return rows.mapInArrow(run, "shard int, lang string, windows binary")


def candidates(windows: DataFrame, power: int, longer) -> DataFrame:
    """(lang, phrase): the phrases at the windows' beginnings that the sketches don't rule out, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            for lang, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                words, fresh = Words(block.as_py(), 0, _lang_hash(lang)), []
                first = np.flatnonzero(np.diff(words.piece, prepend=-1))  # each window is a piece
                for k in range(2, WORDS + 1):
                    hashes, whole = words.phrases(k)
                    at = first[first < len(hashes)]
                    at = at[whole[at]]
                    if k > 2:
                        at = at[_heavy(longer.value, hashes[at] >> np.uint64(64 - power))]
                    names, places = np.unique(hashes[at], return_index=True)
                    for h, i in zip(names.tolist(), at[places].tolist()):
                        if h not in told:
                            told.add(h)
                            fresh.append(words.text(i, k))
                if len(told) > TOLD:  # some are then told again; distinct sees to it
                    told.clear()
                if fresh:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(fresh), pa.string()), pa.array(fresh, pa.string())], ["lang", "phrase"])
        release()

    return windows.select("lang", "windows").mapInArrow(run, "lang string, phrase string").distinct()


_SPACES = re.compile(b"  +")


class Automata:
    """Counts the phrases (lang, phrase) that windows begin with.

    A phrase is guarded by the line feed before it and the space behind it, so a match begins where a window does and ends where a
    word does; phrases that begin alike match at one place, each.
    """

    def __init__(self, phrases: list[tuple[str, str]]):
        self.known: dict[str, ahocorasick.Automaton] = {}
        for i, (lang, phrase) in enumerate(phrases):
            self.known.setdefault(lang, ahocorasick.Automaton(ahocorasick.STORE_INTS)).add_word(f"\n{phrase} ", i)
        for automaton in self.known.values():
            automaton.make_automaton()

    def count(self, lang: str, windows: bytes, counts: np.ndarray) -> None:
        """Adds to counts, by place in phrases."""
        if lang in self.known:
            text = _SPACES.sub(b" ", b"\n%b " % windows.replace(b"\n", b" \n")).decode()
            np.add.at(counts, np.fromiter(map(itemgetter(1), self.known[lang].iter(text)), np.int64), 1)


class Vocabulary:
    """Counts the words (lang, word) of chunks."""

    def __init__(self, words: list[tuple[str, str]]):
        self.known: dict[str, dict[bytes, int]] = {}
        for i, (lang, word) in enumerate(words):
            self.known.setdefault(lang, {})[word.encode()] = i

    def count(self, lang: str, chunk: bytes, ahead: int, counts: np.ndarray) -> None:
        known = self.known.get(lang, {})
        words = [w for w in chunk.replace(b"\n", b" ").split(b" ") if w]
        each = Counter(words[: len(words) - ahead])
        for w in each.keys() & known.keys():
            counts[known[w]] += each[w]


_made: dict[str, Automata | Vocabulary] = {}


def counted(rows: DataFrame, phrases: pa.Table, words: bool = False) -> DataFrame:
    """(lang, phrase, n): how often each of the phrases (lang, phrase), a bounded table, begins a window of rows (lang, windows),
    or, with words, how often each of the words occurs in rows (lang, text)."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, phrases.schema) as writer:
        writer.write_table(phrases)
    shared, key = rows.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex

    def table() -> pa.Table:
        return pa.ipc.open_stream(shared.value).read_all()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _made:  # one at a time in each worker
            _made.clear()
            _made[key] = (Vocabulary if words else Automata)(list(zip(*[c.to_pylist() for c in table().columns])))
        counts = np.zeros(-(-table().num_rows // COUNTS) * COUNTS, np.int64)
        for batch in batches:
            if words:
                for lang, texts in _by_language(batch):
                    for chunk, ahead in chunks(texts):
                        _made[key].count(lang, chunk, ahead, counts)
            else:
                for lang, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                    _made[key].count(lang, block.as_py(), counts)
        release()
        some = [(i, x.tobytes()) for i, x in enumerate(counts.reshape(-1, COUNTS)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], ["block", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(data.as_py(), np.int64)
                sums[block] = sums[block] + counts if block in sums else counts
        known = table() if sums else None
        for block, counts in sums.items():
            some = np.flatnonzero(counts)
            yield from known.take(some + block * COUNTS).append_column("n", pa.array(counts[some])).combine_chunks().to_batches()

    return rows.mapInArrow(run, "block int, counts binary").repartition("block").mapInArrow(summed, "lang string, phrase string, n long")


def _slices(table: pa.Table, size: int) -> Iterator[pa.Table]:
    for at in range(0, table.num_rows, size):
        yield table.slice(at, size)


def frequencies(rows: DataFrame, least: int = LEAST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, n), (lang, n)) of rows (lang, text): how often each phrase of 2 to WORDS words occurs within pieces, of those
    that occur `least` times, and each word of these; and the words of each language.

    Sketches bound the counts from above: one of pairs first, then one of longer phrases that have only heavy pairs. Where phrases
    may begin, windows of the text are dealt to shards by their first pair. The candidates of a shard are compiled into
    automata, `shard` phrases each, which count its windows; so the text is read four times, however many shards there are.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    power = min(max((size // BYTES_PER_CELL).bit_length(), FEWEST), MOST)
    bits, totals = heavy_cells(rows, power, least)
    pairs = spark.sparkContext.broadcast(bits)
    more, _ = heavy_cells(rows, power, least, pairs)
    longer = spark.sparkContext.broadcast(more)
    heavy = int(np.bitwise_count(bits).sum(dtype=np.int64) + np.bitwise_count(more).sum(dtype=np.int64))
    shards = max(1, -(-heavy // shard))
    windows = checkpointed(routed(rows, power, pairs, shards), "shard")
    parts = []
    for i in range(shards):
        mine = windows.filter(F.col("shard") == i).select("lang", "windows")
        # about `shard` phrases: the hash deals pairs evenly, and a pair with more longer phrases than that takes several automata
        for phrases in _slices(candidates(mine, power, longer).toArrow(), shard):
            parts.append(checkpointed(counted(mine, phrases).filter(F.col("n") >= least)))
    if not parts:
        parts = [spark.createDataFrame([], "lang string, phrase string, n long")]
    found = checkpointed(reduce(DataFrame.unionByName, parts))
    single = found.select("lang", F.explode(F.split("phrase", " ")).alias("phrase")).distinct()
    for words in _slices(single.toArrow(), 2 * shard):
        found = found.unionByName(checkpointed(counted(rows, words, words=True)))
    return found, totals


def _joined(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, least: int = LEAST, within: int = WITHIN, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language by score, a and phrase.

    Everything is per language; null languages are one, `und`. Null and empty texts have no words; copies and rows that repeat
    count each; ids aren't looked at, nor are other columns; an empty table has no phrases. Whole texts are read, in chunks.
    Equal scores go by a, then by the bytes of the phrase; of equal cuts the first counts. least: at most 255.
    """
    if not 1 <= least <= 255:
        raise ValueError("a sketch counts to 255")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with scratch(docs.sparkSession):
        counts, totals = frequencies(rows, least, shard)
        counts = checkpointed(counts)
        words = F.split("phrase", " ")
        phrases = counts.select("lang", "phrase", F.col("n").alias("a"), words.alias("words"), F.size(words).alias("k")).filter("k > 1")
        cuts = phrases.select("lang", "phrase", "a", "words", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
        cuts = cuts.select(
            "lang", "phrase", "a", "cut", _joined(F.col("words"), 1, F.col("cut")).alias("first"), _joined(F.col("words"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest")
        )
        left = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
        right = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
        score = F.expr("cast(2000000 as decimal(19,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
        scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).select("lang", "phrase", "a", score.alias("score"), "cut", "l", "r")
        scored = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
        # all parts of two words or more, and the most frequent phrase around each
        spots = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: _joined(F.col("words"), at, size))))
        around = phrases.filter("k > 2").select("lang", F.explode(F.array_distinct(spots)).alias("phrase"), "a")
        around = around.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
        apart = F.expr(f"most is null or cast(100 as decimal(19,0)) * cast(most as decimal(19,0)) < cast({within} as decimal(19,0)) * cast(a as decimal(19,0))")
        kept = scored.join(around, ["lang", "phrase"], "left").filter(apart).join(totals, "lang")
        order = Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase")
        ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        return lasting(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "low.l", "low.r", "n", "low.score"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of documents: lang, rank, phrase, a, l, r, n, score."""
    return collocations(read(spark, sf_dir, "documents"))


OP11_SQL = f"""
with pieces as (
    select lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w
    from (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)),
spots as (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, range(1, {WORDS + 1}) s(k) where len(w) >= k),
counts as (select lang, w[i:i + k - 1] as p, any_value(k) as k, count(*) as n from spots group by 1, 2 having count(*) >= {LEAST}),
totals as (select lang, cast(sum(len(w)) as bigint) as n from pieces group by 1),
cuts as (select lang, p, n as a, k, unnest(range(1, k)) as cut from counts where k > 1),
cut_scores as (
    select c.lang, c.p, c.a, c.cut, f.n as l, g.n as r, cast(cast(2000000 as hugeint) * c.a // (f.n + g.n) as bigint) as score
    from cuts c join counts f on f.lang = c.lang and f.p = c.p[1:c.cut] join counts g on g.lang = c.lang and g.p = c.p[c.cut + 1:]),
lowest as (select lang, p, a, min({{'score': score, 'cut': cut, 'l': l, 'r': r}}) as low from cut_scores group by 1, 2, 3),
parts as (select lang, p, n, k, size, unnest(range(1, k - size + 2)) as i from counts, range(2, {WORDS}) s(size) where size < k),
around as (select lang, p[i:i + size - 1] as p, max(n) as most from parts group by 1, 2),
kept as (select * from lowest left join around using (lang, p) where most is null or 100 * cast(most as hugeint) < {WITHIN} * cast(a as hugeint)),
ranked as (select *, array_to_string(p, ' ') as phrase, row_number() over (partition by lang order by low.score desc, a desc, array_to_string(p, ' ')) as rank from kept)
select lang, rank, phrase, a, low.l as l, low.r as r, n, low.score as score from ranked join totals using (lang) where rank <= {TOP}
"""
