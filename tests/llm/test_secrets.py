import hashlib
import math
import random
import re
from collections import Counter

from tests.helpers import duck, same
from tidemark.llm import registry, secrets

PATTERNS = {
    "assign": re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def plain_base(text):
    """(start, kind, end) by the definition: match, then drop."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            if (len(m[2]) >= 8) if kind == "assign" else len(m[0]) >= {"access": 16, "hex": 32}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def plain_added(text):
    """Each window's entropy on its own, from scratch."""
    out = []
    for k, a in enumerate(secrets.ALPHABETS):
        symbols = set(a.symbols) | (set(a.symbols.upper()) if a.folded else set())
        for m in re.finditer(rf"[{re.escape(''.join(sorted(symbols)))}]+", text):
            if len(m[0]) < a.window or any(re.search(x, m[0]) for x in secrets.ALLOW):
                continue
            chars = m[0].lower() if a.folded else m[0]
            spans = []
            for i in range(len(chars) - a.window + 1):
                counts = Counter(chars[i : i + a.window]).values()
                entropy = -sum(c / a.window * math.log2(c / a.window) for c in counts)
                if entropy >= a.bits - 1e-7:
                    start, end = m.start() + i, m.start() + i + a.window
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = end
                    else:
                        spans.append([start, end])
            out += [(s, len(secrets.BASE) + k, e) for s, e in spans]
    return sorted(out)


def texts():
    draw = random.Random(3)
    b64 = secrets.ALPHABETS[1].symbols
    parts = ["token", "Api_Key", "apikey", "PASSWORD", "secret", '"', "'", " ", "  ", ":", "=", "abcdefgh", "abc", "AKIA", "A1B2C3D4E5F6", "é", "😀", "\n", ".", "deadbeef" * 4, "0" * 40]
    out = ["", "x" * 300, "token = token=abcdefgh password=secret:abcdefgh", "AKIA AKIAAKIAAAAAAAAAAAA", "password" + " " * 5000 + "x", "ſecret: abcdefgh", "toKen: abcdefgh", "token:=abcdefg"]
    for _ in range(300):
        out.append("".join(draw.choice(parts) for _ in range(draw.randrange(14))))
    for _ in range(60):
        size = draw.randrange(20, 90)
        kind = draw.choice(["0123456789abcdef", "0123456789ABCDEF", "0123456789", b64, "abcdefgh", "etaoin"])
        out.append(f"{draw.choice(parts)} {''.join(draw.choice(kind) for _ in range(size))} {draw.choice(parts)}")
    out += ["123e4567-e89b-12d3-a456-426614174000", "q7" * 20 + "".join(draw.choice(b64) for _ in range(40)) + "z" * 40 + "".join(draw.choice(b64) for _ in range(40)), f"example{''.join(draw.choice(b64) for _ in range(40))}"]
    return out


def test_spans_are_the_plain_definition(spark):
    given = texts()
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(8)
    found = {r["doc_id"]: r for r in secrets.spans(docs).collect()}
    assert len(found) == len(given)
    added = 0
    for i, text in enumerate(given):
        assert [tuple(s) for s in found[i]["base"]] == plain_base(text), text
        assert [tuple(s) for s in found[i]["added"]] == plain_added(text), text
        added += len(found[i]["added"])
    assert added > 30


def test_many_matches_of_a_long_text_keep_their_places(spark):
    """3,000 matches of one text: running places go over many blocks."""
    draw = random.Random(5)
    text = " ".join(f"é token: {draw.randrange(10**9, 10**10)}" for _ in range(3000))
    row = secrets.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(s) for s in row["base"]] == plain_base(text) and len(row["base"]) == 3000


def test_entropy_of_long_candidates(spark):
    """A candidate of 20,000 characters with stretches of both kinds."""
    draw = random.Random(6)
    parts = ["".join(draw.choice(secrets.ALPHABETS[1].symbols if i % 2 else "ab1") for _ in range(draw.randrange(10, 400))) for i in range(100)]
    text = "".join(parts)
    row = secrets.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(s) for s in row["added"]] == plain_added(text) and len(row["added"]) > 20


def test_secrets_shows_the_texts(spark):
    rows = secrets.secrets(spark.createDataFrame([(7, "é😀 token: abcdefgh1 end"), (8, None)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in rows] == [(7, "assign", 3, 19, "token: abcdefgh1")]


def test_odd_rows(spark, odd, empty):
    found = secrets.spans(odd).collect()
    assert len(found) == odd.count() and secrets.spans(empty).count() == 0 and secrets.secrets(odd).count() == 0
    assert {r["doc_id"] for r in found if r["base"] or r["added"]} == set()


def test_query_equals_sql_and_the_definition(spark, sf_dir):
    found = secrets.op12_secrets(spark, sf_dir)
    same(found, duck(sf_dir), registry.ORACLE_SQL["op12_secrets"])
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in found.collect():
        base = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in plain_base(docs[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == base.count(":") // 2
