import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import golay, simhash
from tidemark.llm.components import connected_components
from tidemark.llm.simhash import fingerprints, keep_one, links, near_duplicates, op7_simhash


def brute_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_golay_code_is_perfect():
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    messages = np.arange(1 << 12)
    low, high, _ = golay._tables()
    code = (messages << 11) | high[messages << 11 >> 12] ^ low[(messages << 11) & 0xFFF]
    distance = np.bitwise_count(code[golay.index(words)] ^ words)
    assert distance.max() <= 3
    best = np.bitwise_count(code[None, :] ^ words[:200, None]).min(axis=1)
    assert (best == distance[:200]).all()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, (1 << 23) - 1), st.integers(0, 22), st.integers(0, 22))
def test_words_two_bits_apart_share_an_index(word, i, j):
    other = word ^ (1 << i) ^ (1 << j if j != i else 0)
    a = set(golay.nearby(np.array([word]))[1])
    assert len(a) in (1, 6) and a & set(golay.nearby(np.array([other]))[1])


def reference_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAbB \t\néÀ ", max_size=60))
def test_fingerprint_is_the_plain_definition(text):
    assert simhash.simhash(text) == reference_fingerprint(text)


def test_streamed_words_give_the_same_fingerprint(monkeypatch):
    text = "The quick brown fox, jumps over\tthe lazy dog. " * 400
    whole = simhash.simhash(text)
    monkeypatch.setattr(simhash, "LONG_TEXT", 10)
    assert simhash.simhash(text) == whole == reference_fingerprint(text)


@pytest.mark.parametrize("pairwise", [32, 2])
def test_links_reach_what_all_pairs_reach(spark, monkeypatch, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)  # 2: nearly all buckets go the way of large ones
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(25):
        x = int(rng.integers(-(1 << 63), 1 << 63))
        for _ in range(int(rng.integers(1, 60))):
            fps.add(x)
            for b in rng.integers(0, 64, int(rng.integers(0, 4))):
                x ^= 1 << int(b) if b < 63 else -(1 << 63)
    fps = sorted(fps)
    array = np.array(fps, dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(array[:, None] ^ array[None, :]) <= 2
    pairs = [(fps[i], fps[j]) for i, j in zip(*np.nonzero(near)) if i < j]
    found = [tuple(r) for r in links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    assert brute_components(found, fps) == brute_components(pairs, fps)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (100, 90)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    nodes = {n for p in pairs for n in p}
    assert found == brute_components(pairs, nodes) and connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_odd_rows(odd, empty):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count() and near_duplicates(empty).isEmpty()
    by_id = {r["doc_id"]: r for r in rows}
    assert {by_id[k]["fp"] for k in (1, 2, 3)} == {0} and {by_id[k]["component_id"] for k in (1, 2, 3)} == {1}
    assert by_id[7]["component_id"] == 6 and by_id[None]["component_id"] is None
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 5, 6, 8]


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    """Copies go and unlike texts stay, whatever their ids; of equal rows one stays."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (6, c, "x"), (6, d, "x"), (None, c, "x"), (None, "no id", "z"), (None, "no id", "y"), (9, d, "x"), (7, b, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tid string").withColumn("labels", F.create_map(F.lit("k"), "tid"))
    kept = sorted((r["doc_id"] or 0, r["text"], r["tid"]) for r in keep_one(docs).collect())
    assert kept == sorted([(1, a, "x"), (5, b, "x"), (6, c, "x"), (6, d, "x"), (0, "no id", "y")])
    assert keep_one(docs).columns == docs.columns and keep_one(docs.limit(0)).isEmpty()


def test_query_against_all_pairs(spark, sf_dir):
    found = op7_simhash(spark, sf_dir).collect()
    fps = np.array([int(r["fingerprint"], 16) for r in found], dtype=np.uint64)
    ids = [r["doc_id"] for r in found]
    pairs = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)) if i < j]
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(pairs, ids)
    assert fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).count() == len(found)


def jaccard(a, b):
    a, b = ({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("tries", [simhash.TRIES, ()])
def test_stage_finds_planted_near_copies(spark, monkeypatch, tries):
    """Copies of 0.8 and more go, however large their group; less similar texts stay. Without tries, all is left to blocks."""
    monkeypatch.setattr(simhash, "TRIES", tries)
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 9)
    rng = np.random.default_rng(3)
    docs, kept = [], []
    for base in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        docs.append(" ".join(words))
        kept.append(len(docs) - 1)
        for changes in (1, 2, 3, 4) * (20 if base == 0 else 1):
            copy = list(words)
            for at in rng.choice(np.arange(5, 195, 10), changes, replace=False):
                copy[at] = f"new{rng.integers(1 << 40)}"
            docs.append(" ".join(copy))
            assert jaccard(docs[kept[-1]], docs[-1]) >= 0.8
        other = list(words)
        for at in range(5, 195, 20):
            other[at] = f"new{rng.integers(1 << 40)}"
        assert jaccard(" ".join(words), " ".join(other)) < 0.8
        docs.append(" ".join(other))
        kept.append(len(docs) - 1)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(frame).collect()) == kept
