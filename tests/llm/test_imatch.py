import hashlib
import math
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import imatch
from tidemark.llm.common import read


def test_edited():
    assert imatch.edited("abcdef", "XY") == "abcXY" and imatch.edited("abcde", "WXYZ") == "abcWX" and imatch.edited("", "x") == ""


def test_likeness():
    words = imatch.Lexicon(np.array([imatch.term_hash(f"w{i}") for i in range(4000)]))
    text = " ".join(f"w{i}" for i in range(200))
    near = text.replace("w7 ", "w3999 ")
    far = " ".join(f"w{i}" for i in range(2000, 2200))
    one = words.fingerprint(text)
    assert one == words.fingerprint(" ".join(reversed(text.split())) + " w5 other words")
    assert imatch.likeness(one, one) == 1 and imatch.likeness(one, words.fingerprint(near)) > 0.4 > 0.01 > imatch.likeness(one, words.fingerprint(far))
    assert imatch.likeness(words.fingerprint(""), words.fingerprint("")) == 1
    assert imatch.likeness(words.fingerprint("aa"), words.fingerprint("bb")) == 0


def plain_fingerprint(text, lexicon):
    """I-Match by its definition: for each draw, the hash of the sorted distinct terms of the draw's part of the lexicon."""
    found = sorted({t.lower() for t in imatch.TERM.findall(text.lower())})
    keys = sorted(imatch.term_hash(t) for t in found if t in lexicon)
    out = []
    for k, rate in enumerate(r for r in imatch.RATES for _ in range(imatch.DRAWS)):
        mine = []
        for key in keys:
            z = (key + 0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64)
            z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
            z = (z ^ (z >> 27)) * 0x94D049BB133111EB % (1 << 64)
            if (z ^ (z >> 31)) >> 11 < int(rate * (1 << 53)):
                mine.append(key)
        packed = b"".join(key.to_bytes(8, "little", signed=True) for key in mine)
        out.append(f"{xxhash.xxh64_intdigest(packed) % 0xFFFF + 1:04x}" if mine else "0000")
    return out, hashlib.sha256("\n".join(found).encode()).hexdigest()[:8] if found and not keys else "00000000"


def plain_likeness(a, b):
    used = [k for k in range(len(a[0])) if (a[0][k], b[0][k]) != ("0000", "0000")]
    return sum(a[0][k] == b[0][k] for k in used) / len(used) if used else float(a[1] == b[1])


def plain_lexicon(texts):
    df = Counter(t for x in texts for t in set(imatch.TERM.findall((x or "").lower())))
    n = len(texts)
    return {t for t, c in df.items() if max(2, math.ceil(imatch.RAREST * n)) <= c <= math.floor(imatch.COMMONEST * n)}


def check(docs, rows, lexicon=None):
    """The edited texts and, with a lexicon, fingerprints and likenesses are those of the plain definitions."""
    texts = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: r[0])
    found = sorted((tuple(r) for r in rows), key=lambda r: r[0])
    assert len(found) == len(texts)
    prints = {}
    for i, (doc_id, text) in enumerate(texts):
        following = texts[(i + 1) % len(texts)][1]
        changed = imatch.edited(text, following)
        assert found[i][:3] == (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest())
        if lexicon is not None:
            mine, other, after = (prints.setdefault(t, plain_fingerprint(t, lexicon)) for t in (text, changed, following))
            assert found[i][3:] == ("".join(mine[0]) + mine[1], "".join(other[0]) + other[1], plain_likeness(mine, other), plain_likeness(mine, after))


def dealt_by(monkeypatch, rows):
    dealt = imatch.dealt
    monkeypatch.setattr(imatch, "dealt", lambda d: dealt(d, per_bucket=rows))


def test_every_row_meets_the_next_across_buckets(spark, monkeypatch):
    docs = spark.createDataFrame([(i * 7 % 101, f"text number {i} " * (i % 5)) for i in range(101)], "doc_id long, text string")
    lexicon = plain_lexicon([r["text"] for r in docs.collect()])
    dealt_by(monkeypatch, 9)
    check(docs, imatch.compare(docs, imatch.lexicon(docs)).collect(), lexicon)
    one = docs.filter("doc_id = 3")
    check(one, imatch.compare(one, imatch.lexicon(docs)).collect(), lexicon)


def test_rows_that_share_an_id_are_split(spark, monkeypatch):
    """One id (or none) for most rows: they go by their texts' hashes, over several buckets."""
    rows = [(5 if i % 2 else None, f"text {i % 150}") for i in range(400)] + [(7, "last"), (-3, "early")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt_by(monkeypatch, 10)
    assert imatch.dealt(docs).select("bucket").distinct().count() > 12
    ordered = [
        tuple(r)
        for r in docs.selectExpr("doc_id", "text", "xxhash64(text) h").orderBy(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text").collect()
    ]
    expected = [(a, hashlib.sha256(imatch.edited(t, u).encode()).hexdigest()) for (a, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1])]
    found = [(r["doc_id"], r["edited_sha256"]) for r in imatch.compare(docs, imatch.lexicon(docs)).collect()]
    assert Counter(found) == Counter(expected)


def test_a_large_lexicon_is_joined(spark, sf_dir, odd, monkeypatch):
    """The way of lexicons beyond a broadcast gives the same."""
    for docs in (read(spark, sf_dir, "documents").select("doc_id", "text"), odd):
        whole = Counter(map(tuple, imatch.compare(docs, imatch.lexicon(docs)).collect()))
        prints = Counter(map(tuple, imatch.fingerprints(docs, imatch.lexicon(docs)).collect()))
        with monkeypatch.context() as m:
            m.setattr(imatch, "BROADCAST_TERMS", 0)
            table = imatch.lexicon(docs)
            assert not isinstance(table, imatch.Lexicon) or not len(table.keys)
            assert Counter(map(tuple, imatch.compare(docs, table).collect())) == whole
            assert Counter(map(tuple, imatch.fingerprints(docs, table).collect())) == prints


def test_odd_rows(odd, empty):
    rows = imatch.compare(odd, imatch.lexicon(odd)).collect()
    assert len(rows) == odd.count() and imatch.compare(empty, imatch.lexicon(empty)).isEmpty()
    same = {r["fingerprint"] for r in rows if r["doc_id"] in (6, 7)}
    assert len(same) == 1 and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in rows)
    assert imatch.fingerprints(odd, imatch.lexicon(odd)).count() == odd.count()


def test_query(spark, sf_dir):
    rows = imatch.op3_imatch(spark, sf_dir).collect()
    docs = read(spark, sf_dir, "documents")
    check(docs, rows, plain_lexicon([r["text"] for r in docs.collect()]))
    mean = lambda c: sum(r[c] for r in rows) / len(rows)
    assert mean("near_edited") > 5 * mean("near_next")


def test_frequencies_count_documents(spark):
    docs = spark.createDataFrame([("a b a",), ("B c",), (None,)], "text string")
    found = {r["term"]: r["df"] for r in imatch.frequencies(docs).collect()}
    assert found == {imatch.term_hash(t): n for t, n in (("a", 1), ("b", 2), ("c", 1))}
