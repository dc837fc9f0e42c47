import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.helpers import duck, same
from tidemark.llm import phrases, registry

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_counts(docs):
    """Counts of all phrases of 1 to 4 words, and of words, by language."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    return counts, totals


def plain(docs, least, within=80, top=2000):
    counts, totals = plain_counts(docs)
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= within * a for b in longer):
                continue
            score, cut = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def texts(n=400):
    draw = random.Random(4)
    words = ["new", "york", "of", "the", "a", "A", "New", "é", "ÉA", "x" * 40, "z\xa0z", "city", "hall", "\U0001f600"]
    joins = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "! "]
    out = []
    for _ in range(n):
        text = "".join(draw.choice(words) + draw.choice(joins) for _ in range(draw.randrange(40)))
        out.append((draw.choice(["en", "en", "fr", None]), text))
    return [*out, ("en", None), (None, ""), ("en", "new york city hall " * 300), ("fr", "the the the the the " * 50), ("x", " \t\n. ")]


@pytest.mark.parametrize(("least", "shard"), [(3, 300_000), (30, 300_000), (12, 40)])
def test_equals_the_definition(spark, least, shard):
    """Also with candidates spread over several automata."""
    docs = texts()
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    found = sorted(tuple(r) for r in phrases.collocations(df, least=least, top=50, shard=shard).collect())
    assert found == plain(docs, least, top=50) and found


def test_sketches_bound_from_above(spark):
    """Every frequent pair lies in a heavy cell, and the words are counted."""
    docs = texts(200)
    df = spark.createDataFrame(docs, "lang string, text string")
    bits, totals = phrases.heavy_cells(df.na.fill({"lang": "und", "text": ""}), 16, 5)
    counts, sums = plain_counts(docs)
    for lang, f in counts.items():
        key = phrases._lang_hash(lang)
        for p, n in f.items():
            if len(p) == 2 and n >= 5:
                hashes, _ = phrases.Words(" ".join(p).encode(), 0, key).phrases(2)
                assert phrases._heavy(bits, hashes >> 48).all()
    assert {r["lang"]: r["n"] for r in totals.collect()} == dict(sums)


@pytest.mark.parametrize("size", [20, 64, 300])
def test_long_texts_are_cut_without_loss(size):
    """Phrases across a cut are found once, whether it lies between pieces or words."""
    draw = random.Random(1)
    for _ in range(60):
        text = "".join(draw.choice(["a", "bb", "c" * draw.randrange(1, 90), "é"]) + draw.choice([" ", " ", "  ", " ", "\n", "\t"]) for _ in range(draw.randrange(200)))
        given = [text.encode(), b"a bb", text[::2].encode()]
        found = Counter()
        for chunk, ahead in phrases.chunks(given, size):
            words = phrases.Words(chunk, ahead, 5)
            for k in range(1, 5):
                _, new = words.phrases(k)
                found.update(words.text(i, k) for i in new.nonzero()[0].tolist())
        counts, _ = plain_counts([("en", x.decode()) for x in given])
        assert found == Counter({" ".join(p): n for p, n in counts["en"].items()})
        names = [p for p in sorted(found) if " " not in p]
        vocabulary, again = phrases.Vocabulary([("en", p) for p in names]), np.zeros(len(names), np.int64)
        for chunk, ahead in phrases.chunks(given, size):
            vocabulary.count("en", chunk, ahead, again)
        assert dict(zip(names, again.tolist())) == {p: found[p] for p in names}


def test_automata_count_what_windows_begin_with():
    windows = [b"a b c d", b"a  b", b"b c d", b"a bc d", b"a b"]
    names = ["a b", "a b c", "b c", "a bc", "b"]
    counts = np.zeros(len(names), np.int64)
    phrases.Automata([("en", p) for p in names]).count("en", b"\n".join(windows), counts)
    assert counts.tolist() == [3, 1, 1, 1, 1]


def test_odd_rows(spark, odd, empty):
    found = sorted(tuple(r) for r in phrases.collocations(odd, least=2).collect())
    assert found == plain([(r["lang"], r["text"]) for r in odd.collect()], 2) and found
    assert phrases.collocations(empty).count() == 0


def test_query_equals_sql(spark, sf_dir):
    found = phrases.op11_phrases(spark, sf_dir)
    same(found, duck(sf_dir), registry.ORACLE_SQL["op11_phrases"])
    assert found.count() > 20
