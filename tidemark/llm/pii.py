"""Personal data: base patterns, and what else fills the slots of the lexical patterns that these seeds induce."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, checkpointed, lasting, read, scratch

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A leftmost match always begins where its run of digits does, so the look-behind changes no match; with it and
# the possessive quantifiers each digit is read once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")

# What makes a token more than a plain word: a digit, an @, or one of these signs between two characters of words.
MARK = re.compile(r"[0-9@._:/=()\[\]#~](?:(?<=[0-9@])|(?<=\w.)(?=\w))", re.DOTALL)
TOKEN_END = re.compile(r"\S*+")
NEXT = re.compile(r"[^\S\n]*+(\S*+)")
LABEL = re.compile(r"[^\W\d_]++[:=](?=.)")
WORD = re.compile(r"\w")
OPENING, CLOSING = "\"'<{`*#$%&", "\"'>}`*#$%&.,;:!?"
#: Tokens of contexts beyond so many code points stand in them as 64 bits of a hash of the whole token.
TOKEN = 40


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards, so that no character is read twice."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points of all base matches, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def word_key(word: str) -> str:
    """A token of a context: in lower case, or a hash of that where it is long."""
    word = word.lower()
    return word if len(word) <= TOKEN else f"#{xxhash.xxh64_hexdigest(word.encode(errors='surrogatepass'), 7)}"


def tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of the maximal runs without white space that are more than plain words (MARK)."""
    out, done = [], 0
    for m in MARK.finditer(text):
        if (at := m.start()) >= done:
            while at > done and not text[at - 1].isspace():
                at -= 1
            done = TOKEN_END.match(text, m.start()).end()
            out.append((at, done))
    return out


def before(text: str, start: int, low: int) -> str | None:
    """The lexical pattern left of a position: what its token has before it, from `low` on; if that is no more than signs,
    the token before it on its line too. None without a character of a word."""
    at = start
    while at > low and not text[at - 1].isspace():
        at -= 1
    glue = text[at:start]
    if WORD.search(glue):
        return f"<{word_key(glue)}"
    if at == low and at and not text[at - 1].isspace():
        return None
    while at > low and text[at - 1].isspace() and text[at - 1] != "\n":
        at -= 1
    end = at
    while at > low and not text[at - 1].isspace():
        at -= 1
    return f"<{word_key(text[at:end])}_{word_key(glue)}" if WORD.search(text, at, end) else None


def after(text: str, end: int, high: int) -> str | None:
    """The lexical pattern right of a position, up to `high`, like `before`."""
    at = TOKEN_END.match(text, end, high).end()
    glue = text[end:at]
    if WORD.search(glue):
        return f">{word_key(glue)}"
    word = NEXT.match(text, at, high)[1]
    return f">{word_key(glue)}_{word_key(word)}" if WORD.search(word) else None


def fillers(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of what may fill the slot of a pattern: the longest runs of neighbouring tokens on a line that are more than
    plain words, without quotes and stops around them or a label before them. Tokens that touch a base match part runs."""
    taken = sorted((a, b) for _, a, b in found)
    out, run, at, reach, open_end = [], None, 0, 0, -1
    for a, b in tokens(text):
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][1])
            at += 1
        if reach > a:
            run = None
            continue
        core_a, core_b = a, b
        while core_a < core_b and text[core_a] in OPENING:
            core_a += 1
        while core_b > core_a and text[core_b - 1] in CLOSING:
            core_b -= 1
        for x, y in ("()", "[]"):  # brackets without their other half
            if text.startswith(x, core_a, core_b) and text.find(y, core_a, core_b) < 0:
                core_a += 1
            elif text.endswith(y, core_a, core_b) and text.find(x, core_a, core_b) < 0:
                core_b -= 1
        label = LABEL.match(text, core_a, core_b)
        if label:
            core_a = label.end()
        if core_a >= core_b:
            run = None
            continue
        if run is not None and open_end + 1 == core_a == a and text[open_end] in " \t\xa0":
            run[1] = core_b
        else:
            run = [core_a, core_b]
            out.append(run)
        run, open_end = (run, b) if core_b == b else (None, -1)
    return [(a, b) for a, b in out]


def shape(value: str) -> int:
    """The signature of a value by its classes of characters: digits in steps of four (from 20 on alike), whether letters outnumber
    them, and whether there are signs."""
    digits = sum("0" <= c <= "9" for c in value)
    letters = sum(map(str.isalpha, value))
    return min(digits // 4, 5) * 4 + (letters > digits) * 2 + (digits + letters < len(value))


def candidates(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str | None, str | None]]:
    """(kind, start, end, left, right context): base matches as seeds; fillers with a context, whose kind is -1 as yet."""
    out = []
    groups = [[(a, b) for k, a, b in found if k == kind] for kind in range(len(KINDS))]
    # contexts end where the next candidate of the group begins, so that no character counts for more than two of them
    for kind, spans in zip([*range(len(KINDS)), -1], [*groups, fillers(text, found)]):
        for i, (a, b) in enumerate(spans):
            left = before(text, a, spans[i - 1][1] if i else 0)
            right = after(text, b, spans[i + 1][0] if i + 1 < len(spans) else len(text))
            if kind >= 0 or left or right:
                out.append((kind, a, b, left, right))
    return out


SPAN = "struct<kind: int, start: long, end: long>"
HIT = "struct<kind: int, start: long, end: long, left: string, right: string, value: long, shape: int>"
_HIT = pa.struct(
    [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("left", pa.string()), ("right", pa.string())]
    + [("value", pa.int64()), ("shape", pa.int32())]
)
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def value_hash(value: str) -> int:
    """64 bits of an identifier in lower case, as a signed long; they stand for it in the graph."""
    found = xxhash.xxh64_intdigest(value.lower().encode(errors="surrogatepass"), 5)
    return found - (1 << 64) if found >> 63 else found


def text_key(text: Column) -> Column:
    """A cryptographic hash of a text, of which its spans are a function; null for null."""
    return F.sha2(text.cast("string").cast("binary"), 256)


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base: array of spans, hits: array of candidates), one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, hits = [], []
            for x in batch.column(2):
                text = x.as_py() or ""
                found = base(text)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                hits.append(
                    [
                        {"kind": k, "start": a, "end": b, "left": x, "right": y, "value": value_hash(text[a:b]), "shape": shape(text[a:b])}
                        for k, a, b, x, y in candidates(text, found)
                    ]
                )
            columns = [batch.column(0), batch.column(1), pa.array(spans, pa.list_(_SPAN)), pa.array(hits, pa.list_(_HIT))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "base", "hits"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(
        run,
        f"doc_id long, text_key string, base array<{SPAN}>, hits array<{HIT}>",
    )


#: Score from which a pattern is accepted, the believed instances it (and a shape) needs, and the belief from which a span is added.
ACCEPT, SUPPORT, BELIEVE = 2.0, 5.0, 0.5


def evidence(detected: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(text_key, kind, start, end, value, context, seed) of each candidate and context of the corpus, each text once; kind is null
    for what no kind's seeds resemble.

    What fills a slot may be of each kind of which `support` seeds have its shape, one a step of digits from it, or the same
    without signs (signs part digits in many ways; but a kind that never goes without them needs some). Shapes are learnt, not listed.
    """
    hits = checkpointed(detected.select("text_key", F.explode("hits").alias("h")).select("text_key", "h.*").distinct())
    # at most 24 shapes of 4 kinds and their neighbours: this broadcast has 128 rows
    near = F.explode(F.array(*[F.col("shape").bitwiseOR(F.lit(sign)) + 4 * step for step in (-1, 0, 1) for sign in (0, 1)])).alias("shape")
    shapes = hits.filter("kind >= 0").select("kind", "value", near).groupBy("kind", "shape").agg(F.countDistinct("value").alias("n"))
    shapes = shapes.filter(F.col("n") >= support).select(F.col("kind").alias("typed"), "shape")
    seeds = hits.filter("kind >= 0").withColumn("typed", F.col("kind"))
    unseen = hits.filter("kind < 0").join(F.broadcast(shapes), "shape", "left")
    both = seeds.withColumn("seed", F.lit(True)).unionByName(unseen.withColumn("seed", F.lit(False)))
    contexts = F.explode(F.array_compact(F.array("left", "right")))
    return checkpointed(both.select("text_key", F.col("typed").alias("kind"), "start", "end", "value", contexts.alias("context"), "seed"))


def patterns(found: DataFrame, accept: float = ACCEPT, support: float = SUPPORT) -> DataFrame:
    """(kind, context, confidence) of the accepted patterns, from the graph of patterns and instances of the whole corpus.

    Instances are distinct values; those of the base are seeds, believed fully. With F the sum of the beliefs in a
    pattern's instances of a kind, and n the number of all that fills its slot, of whatever kind or none, its confidence is F / n and
    its score F / n * log2(F), so that a pattern which many known identifiers support may bring in many unseen ones, but one
    that stands beside everything none. Patterns of score `accept` and F `support` are accepted and stay
    so. An unseen instance is believed by the noisy-or of its accepted patterns' confidences, so that found identifiers
    in turn induce patterns. Rounds go on until none is accepted any more. `found` is the evidence.
    """
    edges = checkpointed(found.groupBy("kind", "context", "value").agg(F.max("seed").alias("seed")))
    loose = checkpointed(edges.filter("kind is not null and not seed").select("kind", "context", "value"))
    # only patterns with unseen instances can find anything
    unseen = loose.select("kind", "context").distinct()
    seeds = edges.filter("seed").groupBy("kind", "context").agg(F.count("*").alias("seeds"))
    totals = edges.select("context", "value").distinct().groupBy("context").agg(F.count("*").alias("n"))
    graph = unseen.join(seeds, ["kind", "context"], "left").join(totals, "context")
    graph = checkpointed(graph.select("kind", "context", "n", F.coalesce("seeds", F.lit(0)).alias("seeds")))
    scored, accepted = graph.select("*", F.lit(0.0).alias("lift"), F.lit(False).alias("accepted")), 0
    while True:
        believed = F.col("seeds") + F.col("lift")
        confidence = believed / F.col("n")
        good = (believed >= support) & (confidence * F.log2(believed) >= accept)
        scored = scored.select("kind", "context", "n", "seeds", (F.col("accepted") | good).alias("accepted"), confidence.alias("confidence"))
        scored = checkpointed(scored)
        taken = scored.filter("accepted").select("kind", "context", "confidence")
        before, accepted = accepted, taken.count()
        if accepted == before:
            return taken
        beliefs = loose.join(taken, ["kind", "context"]).groupBy("kind", "value").agg(noisy_or("confidence").alias("belief"))
        lift = loose.join(beliefs, ["kind", "value"]).groupBy("kind", "context").agg(F.sum("belief").alias("lift"))
        scored = scored.drop("confidence").join(lift, ["kind", "context"], "left").withColumn("lift", F.coalesce("lift", F.lit(0.0)))


def noisy_or(chance: str) -> Column:
    return 1 - F.exp(F.sum(F.log1p(-F.least(chance, F.lit(1 - 1e-9)))))


def additions(found: DataFrame, accepted: DataFrame, believe: float = BELIEVE) -> DataFrame:
    """(text_key, added: array of spans) of the texts in which accepted patterns find more than the base.

    A span is believed by the noisy-or of the patterns on its sides; that must be `believe`. Of several kinds the likeliest
    one names it, of equally likely ones the first of KINDS.
    """
    spans = (
        found.filter("not seed")
        .join(accepted, ["kind", "context"])
        .groupBy("text_key", "start", "end", "kind")
        .agg(noisy_or("confidence").alias("belief"))
        .filter(F.col("belief") >= believe)
        .groupBy("text_key", "start", "end")
        .agg(F.max_by("kind", F.struct(F.round("belief", 9), -F.col("kind"))).alias("kind"))
    )
    return spans.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))


def bootstrapped(detected: DataFrame) -> DataFrame:
    """`additions` of the whole corpus, by its own patterns; broadcast if small."""
    with scratch(detected.sparkSession):
        found = evidence(detected)
        added = lasting(additions(found, patterns(found)))
    n = added.agg(F.coalesce(F.sum(F.size("added") + 1), F.lit(0))).first()[0]
    return F.broadcast(added) if n <= BROADCAST_SPANS else added


#: Added spans (and texts that have some) up to which they are broadcast, which is some 8 MB; beyond it, the join shuffles.
BROADCAST_SPANS = 100_000


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): arrays of (kind, start, end), one row per row of docs.

    kind counts KINDS from 0; start and end are code points, end exclusive; both arrays go by kind and start. Null and
    empty texts have none; an empty table has no rows. Whole texts are read, in time linear in their length (and the
    logarithm of the number of matches). Repeated rows and null ids are kept, each with its spans; copies of a text
    count once as evidence for patterns. Other columns are not looked at.
    """
    detected = checkpointed(detect(docs))
    added = bootstrapped(detected)
    none = F.array().cast(f"array<{SPAN}>")
    return detected.join(added, "text_key", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns for every document: doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans;
    and n_added, the number of spans that the patterns add."""
    found = spans(read(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        (F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)
    ]
    everything = F.array_sort(F.array_union("base", "added"))
    return found.select(
        "doc_id",
        *counts,
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(everything).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def masked(text: str, found: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by [KIND]; of overlapping spans the first, longest one gives the name."""
    out, at = [], 0
    for a, b, k in sorted(((a, b, k) for k, a, b in found), key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """docs, in their own columns, with all spans masked in text, and n_chars (if there) counted anew.

    Null texts stay null and empty ones empty. Rows that repeat, or share an id, are each masked by their own text;
    an empty table stays empty; other columns pass as they are, whatever their names. The corpus is read twice: for
    the patterns, and to mask.
    """
    detected = checkpointed(detect(docs).filter("size(hits) > 0").select("text_key", "hits"))
    added = bootstrapped(detected)
    joined = boxed(docs, text_key=text_key(F.col("text"))).join(added, "text_key", "left").select("row", "added")
    at = docs.columns.index("text")
    sizes = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts = batch.column(0).flatten(), []
            for x, more in zip(columns[at], batch.column(1)):
                text = x.as_py()
                if text is not None:
                    more = [(s["kind"], s["start"], s["end"]) for s in more.as_py() or ()]
                    text = masked(text, base(text) + more)
                texts.append(text)
            columns[at] = pa.array(texts, columns[at].type)
            if sizes is not None:
                old = columns[sizes]
                columns[sizes] = pa.array([o.as_py() if t is None else len(t) for t, o in zip(texts, old)], old.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, docs.schema)
