"""Secrets: base patterns, and strings whose sliding windows have a high Shannon entropy. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read

# Possessive where what follows can't begin with what was taken: the matches stay, nothing is tried twice.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]+)"""
#: Kind and pattern of the base. A shorter run of the last two has no part that could match, so a bound within the
#: pattern drops the same matches as one on what it finds.
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12,}+", "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+"}
#: Characters that an assigned value has at least.
VALUE = 8


@dataclass(frozen=True)
class Alphabet:
    """A class of characters (in either case, if folded) whose runs are candidates.

    window characters at a time are looked at; from `bits` of Shannon entropy a character on, they are a secret.
    """

    kind: str
    symbols: str
    window: int
    bits: float
    folded: bool = False

    @property
    def pattern(self) -> str:
        inside = "".join(f"\\{c}" if c in "-]^\\" else c for c in self.symbols)
        inside += self.symbols.upper() if self.folded else ""
        return rf"[{inside}]{{{self.window},}}"

    @property
    def gains(self) -> list[int]:
        """c * log2(c) in millionths for counts c of 0 to window: what c equal characters take off the entropy."""
        return [round(c * math.log2(c) * 1e6) if c else 0 for c in range(self.window + 1)]

    @property
    def most(self) -> int:
        """The largest sum of gains in a window of entropy `bits`: H = log2(window) - sum / window."""
        return math.floor((math.log2(self.window) - self.bits) * self.window * 1e6)

    @property
    def distinct(self) -> int:
        """Distinct characters without which no window can have the entropy."""
        return math.ceil(2**self.bits - 1e-9)


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Random text of 16 symbols has some 3.3 bits in windows of 24, of 64 symbols some 4.2; words have some 3.
ALPHABETS = (
    Alphabet("entropy16", "0123456789abcdef", 24, 3.0, folded=True),
    Alphabet("entropy64", f"{_LETTERS}{_LETTERS.upper()}0123456789+/_=-", 24, 4.0),
)
#: Candidates that are known to be no secrets, by any of these patterns: plain numbers, words and paths of letters alone,
#: UUIDs, alphabets, and what says that it is an example.
ALLOW = (
    r"^[0-9]+$",
    r"^[A-Za-z/_=-]+$",
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"0123456789abcdef|(?i:abcdefghijklmnop)",
    r"(?i:example|placeholder|changeme|your_)",
)
KINDS = (*BASE, *(a.kind for a in ALPHABETS))
SPAN = "struct<start: bigint, kind: int, end: bigint>"
BLOCK = 64


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(items: Column, start: Column, step: Callable[[Column, Column], Column], out: Callable[[Column], Column], kind: str, last: Callable[[Column], Column] | None = None) -> Column:
    """What a fold over items gives out: step makes the next state of state and item; out(state) is an array of none or
    one values of the type `kind`, and so is last(state) after all items.

    Values are gathered in blocks, so that adding one copies a block and not all that were there before.
    """
    some, many = f"array<{kind}>", f"array<array<{kind}>>"
    zero = F.struct(start.alias("s"), F.array().cast(some).alias("block"), F.array().cast(many).alias("blocks"))

    def go(a: Column, x: Column) -> Column:
        def gathered(s: Column) -> Column:
            full = F.size(a["block"]) >= BLOCK
            more = out(s)
            return F.struct(
                s.alias("s"),
                F.when(full, more).when(F.size(more) > 0, F.concat(a["block"], more)).otherwise(a["block"]).alias("block"),
                F.when(full, F.concat(a["blocks"], F.array(a["block"]))).otherwise(a["blocks"]).alias("blocks"),
            )

        return once(step(a["s"], x), gathered)

    def done(a: Column) -> Column:
        found = F.concat(F.flatten(a["blocks"]), a["block"])
        return F.concat(found, last(a["s"])) if last else found

    return F.aggregate(items, zero, go, done)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of the leftmost non-overlapping matches of a pattern, in code points.

    Spark's functions tell what matches and what lies between, not where: the places are running sums of both lengths.
    """
    kind = "struct<start: bigint, end: bigint, match: string>"
    zero = F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"), F.lit("").alias("match"))

    def step(s: Column, x: Column) -> Column:
        start = s["end"] + x["gap"]
        return F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["match"].alias("match"))

    def placed(found: Column) -> Column:
        def among(gaps: Column) -> Column:
            pairs = F.transform(
                found, lambda m, i: F.struct(F.char_length(F.get(gaps, i)).alias("gap"), F.char_length(m).alias("size"), m.alias("match"))
            )
            return fold(pairs, zero, step, F.array, kind)

        none = F.array().cast(f"array<{kind}>")
        return F.when(F.size(found) == 0, none).otherwise(once(F.split(text, pattern, -1), among))

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def base(text: Column) -> Column:
    """Array of SPAN: the base matches of all kinds."""
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        found = matches(text, pattern)
        if kind == "assign":
            found = F.filter(found, lambda m: F.char_length(F.regexp_extract(m["match"], ASSIGN, 1)) >= VALUE)
        out.append(_spans(found, k))
    return F.concat(*out)


def _spans(found: Column, kind: int) -> Column:
    shaped = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))
    return shaped.cast(f"array<{SPAN}>")


def windows(candidate: Column, alphabet: Alphabet) -> Column:
    """Array of (start, end): the stretches of a candidate, a (start, match), that windows of high entropy cover.

    The window moves by one character at a time: one count falls and one grows, and the sum of gains changes by these two.
    """
    kind = "struct<start: bigint, end: bigint>"
    gains, w = F.array(*map(F.lit, alphabet.gains)), alphabet.window
    text = F.lower(candidate["match"]) if alphabet.folded else candidate["match"]
    nothing = F.lit(None).cast(kind)
    zero = F.struct(
        F.array_repeat(F.lit(0), len(alphabet.symbols)).alias("counts"), F.lit(0).cast("bigint").alias("sum"), nothing.alias("open"), nothing.alias("shut")
    )

    def along(codes: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            moved = F.struct(F.get(codes, i).alias("enters"), F.when(i >= w, F.get(codes, i - w)).otherwise(-1).alias("leaves"))
            return once(moved, lambda m: once(changed(s, m), lambda n: slid(s, n, i)))

        def changed(s: Column, m: Column) -> Column:
            less = F.coalesce(F.get(s["counts"], m["leaves"]), F.lit(0))
            more = F.get(s["counts"], m["enters"]) - (m["enters"] == m["leaves"]).cast("int")
            lost = F.when(m["leaves"] >= 0, F.get(gains, less - 1) - F.get(gains, less)).otherwise(0)
            moved = F.transform(s["counts"], lambda c, j: c + (j == m["enters"]).cast("int") - (j == m["leaves"]).cast("int"))
            return F.struct(moved.alias("counts"), (s["sum"] + lost + F.get(gains, more + 1) - F.get(gains, more)).cast("bigint").alias("sum"))

        def slid(s: Column, n: Column, i: Column) -> Column:
            start, end = candidate["start"] + i + 1 - w, candidate["start"] + i + 1
            hot = (i + 1 >= w) & (n["sum"] <= alphabet.most)
            joins = s["open"].isNotNull() & (start <= s["open"]["end"])
            first = F.when(joins, s["open"]["start"]).otherwise(start)
            now = F.when(hot, F.struct(first.alias("start"), end.alias("end"))).otherwise(s["open"]).cast(kind)
            shut = F.when(hot & ~joins, s["open"]).otherwise(nothing)
            return F.struct(n["counts"].alias("counts"), n["sum"].alias("sum"), now.alias("open"), shut.alias("shut"))

        def out(field: str) -> Callable[[Column], Column]:
            return lambda s: F.when(s[field].isNotNull(), F.array(s[field])).otherwise(F.array().cast(f"array<{kind}>"))

        return fold(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, out("shut"), kind, last=out("open"))

    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(alphabet.symbols), c) - 1)
    return once(codes, along)


def entropic(text: Column, alphabets: tuple[Alphabet, ...] = ALPHABETS, allow: tuple[str, ...] = ALLOW) -> Column:
    """Array of SPAN: what windows of high entropy cover in candidates that the allow-list doesn't name."""
    found = [_spans(_entropic(text, a, allow), len(BASE) + k) for k, a in enumerate(alphabets)]
    return F.concat(*found)


def _entropic(text: Column, alphabet: Alphabet, allow: tuple[str, ...]) -> Column:
    def chosen(m: Column) -> Column:
        # a candidate of few distinct characters has no such window, whatever their order
        rich = F.size(F.array_distinct(F.split(m["match"], ""))) >= alphabet.distinct
        return rich & ~m["match"].rlike("|".join(f"(?:{x})" for x in allow)) if allow else rich

    return F.flatten(F.transform(F.filter(matches(text, alphabet.pattern), chosen), lambda m: windows(m, alphabet)))


def spans(docs: DataFrame, alphabets: tuple[Alphabet, ...] = ALPHABETS, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """(doc_id, base, added): arrays of (start, kind, end), sorted, one row per row of docs.

    kind counts the kinds of BASE and then the alphabets from 0; start and end are code points, end exclusive. Added spans may
    lie within base ones or hold them. Null and empty texts have none; rows that repeat, or have no id, have theirs each; an
    empty table has no rows. Whole texts are read, in time linear in their length; other columns are not looked at. One pass
    over the rows, without a shuffle.
    """
    rows = _texts(docs).withColumn("base", F.sort_array(base(F.col("text"))))
    return rows.select("doc_id", "base", F.sort_array(entropic(F.col("text"), alphabets, allow)).alias("added"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def secrets(docs: DataFrame, alphabets: tuple[Alphabet, ...] = ALPHABETS, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """(doc_id, kind, start, end, secret): one row per span, with its text. Odd rows go as in `spans`."""
    text = F.col("text")
    found = _texts(docs).withColumn("s", F.explode(F.concat(base(text), entropic(text, alphabets, allow))))
    names = F.array(*map(F.lit, (*BASE, *(a.kind for a in alphabets))))
    cut = F.substr(F.col("text"), (F.col("s.start") + 1).cast("int"), (F.col("s.end") - F.col("s.start")).cast("int"))
    return found.select("doc_id", F.get(names, F.col("s.kind")).alias("kind"), "s.start", "s.end", cut.alias("secret"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    shown = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(shown, ",")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns for every document: doc_id, n_assign, n_access, n_hex (of the base), base_sha256, spans; and n_added,
    the number of spans that entropy adds."""
    found = spans(read(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.sort_array(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def _found_sql(kind: int, pattern: str, where: str = "true") -> str:
    """Matches with their places: the lengths of what lies between and of the matches, up to each."""
    pattern = pattern.replace("'", "''")
    return f"""select doc_id, {kind} as kind, i, m, start, start + length(m) as stop from (
        select doc_id, i, ms[i] as m, cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as bigint) as start
        from (select doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) as i from (
            select doc_id, regexp_extract_all(t, '{pattern}') as ms, string_split_regex(t, '{pattern}') as gaps from texts))) where {where}"""


def _entropy_sql(kind: int, a: Alphabet) -> str:
    allowed = " or ".join(f"""regexp_matches(m, '{x.replace("'", "''")}')""" for x in ALLOW)
    text = "lower(m)" if a.folded else "m"
    return f"""
    select doc_id, kind, min(start + s) as start, max(start + s) + {a.window} as stop from (
        select *, sum(cast(fresh as int)) over (partition by doc_id, i order by s) as island from (
        select *, coalesce(s > lag(s) over (partition by doc_id, i order by s) + {a.window}, true) as fresh from (
            select doc_id, kind, i, start, s from (
                select doc_id, kind, i, start, s, ch, count(*) as n from (
                    select doc_id, kind, i, start, s, unnest(string_split(substr({text}, s + 1, {a.window}), '')) as ch from (
                        select *, unnest(range(0, length(m) - {a.window} + 1)) as s from ({_found_sql(kind, a.pattern)}) where not ({allowed})))
                group by all)
            group by all having sum({a.gains}[n + 1]) <= {a.most})))
    group by doc_id, kind, i, island"""


_PLAIN = {"assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
_ASSIGNED = r"""regexp_matches(m, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]{8,}$')"""
_NAMED = "['" + "', '".join(KINDS) + "'][kind + 1] || ':' || start || ':' || stop"

OP12_SQL = f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
based as ({" union all ".join(_found_sql(k, p, _ASSIGNED if kind == "assign" else "true") for k, (kind, p) in enumerate(_PLAIN.items()))}),
added as ({" union all ".join(_entropy_sql(len(BASE) + k, a) for k, a in enumerate(ALPHABETS))}),
every as (select doc_id, kind, start, stop from based union all select * from added)
select doc_id, {", ".join(f"coalesce(n_{kind}, 0) as n_{kind}" for kind in BASE)}, sha256(coalesce(b, '')) as base_sha256, coalesce(s, '') as spans, coalesce(n, 0) as n_added
from texts
left join (select doc_id, {", ".join(f"count_if(kind = {k}) as n_{kind}" for k, kind in enumerate(BASE))}, string_agg({_NAMED}, ',' order by start, kind) as b
    from based group by doc_id) using (doc_id)
left join (select doc_id, string_agg({_NAMED}, ',' order by start, kind, stop) as s, count_if(kind >= {len(BASE)}) as n from every group by doc_id) using (doc_id)
"""
