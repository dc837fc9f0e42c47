"""The prefix trie of conversations: nodes with members, children, leaves and savings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, lasting, read, scratch

#: Conversations that share heads: c takes those of c - c % GROUP, and the number of turns is the crc32 of c modulo HEADS.
GROUP, HEADS = 100, 6
#: Rows (a conversation at a depth) up to which a subtree is built in one place. What has more is an upper level.
HEAVY = 50_000
#: Rows up to which a table of upper levels is broadcast; a larger one is joined by shuffles.
BROADCAST_ROWS = 100_000
#: Bytes of joined ids that travel as one row.
PART_BYTES = 1 << 18

ROOT = "0:0:0"


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, i, hi, lo, size): the turns in order, i from 1, with 128 bits that stand for role and text, and the text's code
    points.

    Turns go by number (null first), then role, then text. Rows are dealt by ranges of this order, so a conversation of any
    length is numbered in parts; the few parts that continue one (one a range at most) learn how many turns lie before.
    """
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id is not null")
    dealt = clean.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("conv_id", "part").orderBy(*order)
    # the length of the role keeps role and text apart
    key = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    bits = [F.conv(F.substring(key, at, 15), 16, 10).cast("long") for at in (1, 16)]
    rows = checkpointed(checkpointed(dealt).select(
        "conv_id", "part", F.row_number().over(within).cast("long").alias("i"), bits[0].alias("hi"), bits[1].alias("lo"), F.char_length("text").cast("long").alias("size")
    ))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    carried = ends.withColumn("before", F.sum("n").over(before)).filter("before is not null").select("conv_id", "part", "before")
    # one part a range at most goes on with a conversation
    rows = rows.join(F.broadcast(carried), ["conv_id", "part"], "left")
    return rows.select("conv_id", "part", (F.col("i") + F.coalesce("before", F.lit(0))).alias("i"), "hi", "lo", "size")


def head_turns(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEADS))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, part, d, hi, lo, size): the rebuilt conversations' turns, d from 1, and one row with d = 0 for each conversation."""
    rows = checkpointed(numbered(turns))
    heads = rows.filter((F.col("conv_id") % GROUP == 0) & (F.col("i") < HEADS))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("i", "hi", "lo", "size"))).alias("head"))  # HEADS - 1 at most
    convs = rows.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    convs = convs.join(heads, "base", "left").select(
        "conv_id", head_turns(F.col("conv_id")).alias("h"), F.coalesce(F.slice("head", F.lit(1), head_turns(F.col("conv_id"))), F.expr("cast(array() as array<struct<i: bigint, hi: bigint, lo: bigint, size: bigint>>)")).alias("head")
    )
    convs = checkpointed(convs)
    first = F.array(F.struct(*[F.lit(0).cast("long").alias(c) for c in ("i", "hi", "lo", "size")]))
    top = convs.select("conv_id", F.lit(-1).alias("part"), F.explode(F.concat(first, "head")).alias("t")).select("conv_id", "part", F.col("t.i").alias("d"), "t.hi", "t.lo", "t.size")
    own = rows.join(convs.select("conv_id", "h", F.size("head").alias("n")), "conv_id").filter("i > h")
    return top.unionByName(own.select("conv_id", "part", (F.col("i") - F.col("h") + F.col("n")).alias("d"), "hi", "lo", "size"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, d, node, parent, size, below): each conversation at each depth, with names of its first d and d - 1 turns and how
    many turns follow.

    A name holds the exclusive or of 120 bits for each turn and its place. Running values go by parts of a conversation, as
    in `numbered`.
    """
    place = F.md5(F.concat_ws(":", "d", "hi", "lo").cast("binary"))
    term = [F.when(F.col("d") > 0, F.conv(F.substring(place, at, 15), 16, 10).cast("long")).otherwise(F.lit(0).cast("long")) for at in (1, 16)]
    rows = checkpointed(rebuilt(turns).select("conv_id", "part", "d", term[0].alias("x"), term[1].alias("y"), "size"))
    within, before = Window.partitionBy("conv_id", "part").orderBy("d"), Window.partitionBy("conv_id").orderBy("part")
    ends = rows.groupBy("conv_id", "part").agg(F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(y)").alias("y"), F.max("d").alias("d"))
    past = before.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv_id")
    ends = checkpointed(ends.select(
        "conv_id", "part", F.expr("bit_xor(x)").over(past).alias("bx"), F.expr("bit_xor(y)").over(past).alias("by"), F.max("d").over(every).alias("length")
    ))
    rows = rows.join(ends, ["conv_id", "part"])
    none = F.lit(0).cast("long")
    upto = {c: F.expr(f"bit_xor({c})").over(within).bitwiseXOR(F.coalesce(f"b{c}", none)) for c in ("x", "y")}
    named = rows.select("conv_id", "d", "size", "length", F.col("x").alias("tx"), F.col("y").alias("ty"), upto["x"].alias("px"), upto["y"].alias("py"))
    node = F.concat_ws(":", "d", F.hex("px"), F.hex("py"))
    parent = F.concat_ws(":", F.col("d") - 1, F.hex(F.col("px").bitwiseXOR(F.col("tx"))), F.hex(F.col("py").bitwiseXOR(F.col("ty"))))
    return named.select("conv_id", "d", node.alias("node"), F.when(F.col("d") > 0, parent).alias("parent"), "size", (F.col("length") - F.col("d")).alias("below"))


class Louds:
    """A forest as level-order unary degrees: a bitvector with, for each node in level order, a one for each child and then a
    zero; the root of all its roots comes first. Values of the nodes are arrays in that order, from 1."""

    def __init__(self, parents: np.ndarray, levels: np.ndarray, labels: np.ndarray):
        """parents: the row of each row's parent, -1 for roots; levels: distance from the root. Children go by label."""
        n = len(parents)
        place, self.starts = np.zeros(n + 1, np.int64), [1]  # the place of each row in level order; that of no row is 0
        by_level = np.argsort(levels, kind="stable")
        for rows in np.split(by_level, np.cumsum(np.bincount(levels))[:-1]) if n else []:
            rows = rows[np.lexsort((labels[rows], place[parents[rows]]))]
            place[rows] = self.starts[-1] + np.arange(len(rows))
            self.starts.append(self.starts[-1] + len(rows))
        self.order = np.argsort(place[:n])
        self.labels = labels[self.order]
        degrees = np.bincount(place[parents], minlength=n + 1) if n else np.zeros(1, np.int64)
        self.bits = np.ones(2 * n + 1, bool)
        self.bits[np.cumsum(degrees + 1) - 1] = False
        self.ones, self.zeros = np.flatnonzero(self.bits), np.flatnonzero(~self.bits)

    def degrees(self) -> np.ndarray:
        """Children of each node: the run of ones before its zero."""
        return np.diff(self.zeros, prepend=-1)[1:] - 1

    def parents(self) -> np.ndarray:
        """The place of each node's parent: the zeros before the node's one."""
        return self.ones - np.arange(len(self.ones))

    def rolled(self, values: np.ndarray) -> np.ndarray:
        """Sums of values over each node's subtree, level by level from the last one up."""
        parents, sums = self.parents(), np.concatenate([np.zeros(1, values.dtype), values])
        for a, b in zip(self.starts[-2::-1], self.starts[:0:-1]):
            np.add.at(sums, parents[a - 1 : b - 1], sums[a:b])
        return sums[1:]


_BUILT = "node string, parent string, d long, conv_id long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long, top boolean"


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of whole subtrees with their sums; top: the root of its subtree, whose parent is elsewhere."""
    names = rows["node"].to_numpy(object)
    by_name = np.argsort(names)
    top = (rows["node"] == rows["root"]).to_numpy()
    wanted = rows["parent"].fillna("").to_numpy(object)
    parents = np.where(top, -1, by_name[np.minimum(np.searchsorted(names[by_name], wanted), len(names) - 1)])
    depth = rows["d"].to_numpy(np.int64)
    level = depth - rows["root"].map(dict(zip(names[top], depth[top]))).to_numpy(np.int64)
    forest = Louds(parents, level, names)
    out = rows.iloc[forest.order][["node", "parent", "d", "conv_id", "n_convs"]].reset_index(drop=True)
    above, conv = forest.parents(), np.concatenate([[0], out["conv_id"].to_numpy(np.int64)])
    out["parent_conv_id"] = pd.array(conv[above], dtype="Int64")
    out.loc[above == 0, "parent_conv_id"] = pd.NA
    degrees = forest.degrees()
    out["n_children"] = degrees
    out["n_leaves"] = forest.rolled((degrees == 0).astype(np.int64))
    out["saved_tokens"] = forest.rolled(((rows["n_convs"] - 1) * rows["size"]).to_numpy(np.int64)[forest.order])
    out["top"] = above == 0
    return out


def _upper(heavy: DataFrame, built: DataFrame) -> DataFrame:
    """The heavy nodes in the columns of built, with the sums over their subtrees.

    What the light subtrees below them add up to is their own at first. Then each node's sum is added to its ancestor's at
    distance 1, 2, 4 and so on, so that as many rounds do as the depth has binary digits.
    """
    tops = built.filter("top and parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.count("*").alias("tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    inner = heavy.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("inner"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    joined = heavy.join(tops, "node", "left").join(inner, "node", "left").withColumn("n_children", number("tops") + number("inner"))
    joined = checkpointed(joined.withColumns({
        "leaves": number("leaves") + (F.col("n_children") == 0).cast("long"), "saved": number("saved") + (F.col("n_convs") - 1) * F.col("size"),
    }))
    state = joined.select("node", F.col("parent").alias("above"), "leaves", "saved")
    while not (lifted := state.filter("above is not null")).isEmpty():
        sums = lifted.groupBy(F.col("above").alias("node")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("most"))
        further = state.select(F.col("node").alias("above"), F.col("above").alias("beyond"))
        state = state.join(sums, "node", "left").join(further, "above", "left")
        state = checkpointed(state.select("node", F.col("beyond").alias("above"), (F.col("leaves") + number("more")).alias("leaves"), (F.col("saved") + number("most")).alias("saved")))
    owners = heavy.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = joined.drop("leaves", "saved").join(state.drop("above"), "node").join(owners, "parent", "left")
    return found.select(
        "node", "parent", "d", "conv_id", "n_convs", "parent_conv_id", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.lit(False).alias("top")
    )


def ends(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv_id): the hash of each node's ids, ascending and comma-joined.

    A hash reads its text from the front, but the text of a node with very many ids is made in parts by many tasks: rows are
    dealt by ranges of node and id. The parts are hashed one after another, and never held together.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, str]] = []
        node, ids, size, total = None, [], 0, 0

        def rows_of() -> pa.RecordBatch:
            columns = [pa.array([h[i] for h in held], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))]
            return pa.RecordBatch.from_arrays(columns, ["node", "first", "ids"])

        for batch in batches:
            for name, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (name != node or size >= PART_BYTES):
                    held.append((node, ids[0], ",".join(map(str, ids))))
                    total += size
                    ids, size = [], 0
                    if total >= 1 << 22:
                        yield rows_of()
                        held, total = [], 0
                node = name
                ids.append(conv)
                size += len(str(conv)) + 1
        if ids:
            held.append((node, ids[0], ",".join(map(str, ids))))
        yield rows_of()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
                if name != node:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    dealt = rows.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    made = dealt.mapInArrow(parts, "node string, first long, ids string")
    return made.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node string, ends_sha256 string")


def trie(turns: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 (see op13_trie), and node and parent, which name it.

    Nodes with more than `heavy` rows below them (a conversation at a depth each) are the upper levels. The subtrees that hang
    from these are whole, so shards of them are built apart, as LOUDS forests; the upper levels then take up their sums.

    Turns go by number (null first), then by role and text, so ties and repeated rows have a defined order and count each;
    rows without conv_id belong to no conversation and take no part; null roles and texts are empty ones; texts and
    conversations may have any length; other columns are not looked at; an empty table has no nodes.
    """
    with scratch(turns.sparkSession):
        rows = checkpointed(prefixes(turns))
        nodes = checkpointed(
            rows.groupBy("node", "parent", "d", "size").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("below") + 1).alias("weight"))
        )
        upper = checkpointed(nodes.filter(F.col("weight") > heavy))
        light = nodes.filter(F.col("weight") <= heavy)
        # each conversation leaves the upper levels at one depth, and the node there is the root of its light subtree
        leaves_at = rows.join(small(upper.select("node")), "node", "left_semi").groupBy("conv_id").agg((F.max("d") + 1).alias("at"))
        roots = rows.select("conv_id", "d", "node").join(leaves_at, "conv_id", "left").filter(F.col("d") == F.coalesce("at", F.lit(0)))
        placed = checkpointed(light.join(roots.select("conv_id", F.col("node").alias("root")), "conv_id"))
        shards = max(1, -(-placed.count() // heavy))
        placed = placed.withColumn("shard", F.pmod(F.xxhash64("root"), F.lit(shards)))
        built = checkpointed(placed.groupBy("shard").applyInPandas(_build, _BUILT))
        owners = small(upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")))
        below = built.join(owners, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*built.columns)
        every = below.unionByName(_upper(upper, built)).join(ends(rows.filter("below = 0")), "node", "left")
        return lasting(every.select(
            "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"), "node", "parent",
        ))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations, each rebuilt with the first turns of its hundred's first one: conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie(read(spark, sf_dir, "conversations")).drop("node", "parent")


_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(c as varchar), ''), lambda x: cast(ord(x) as bigint))),
    lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])), 4294967295)"""

OP13_SQL = f"""
with crc_table as (select list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by b) as crcs
    from (select cast(unnest(range(256)) as bigint) as b)),
own as (select conv_id as c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as xs
    from conversations where conv_id is not null group by conv_id),
sized as (select c, xs, cast({_CRC} % {HEADS} as bigint) as h from own, crc_table),
whole as (select s.c, list_concat(coalesce(b.xs[1:s.h], []), s.xs[s.h + 1:]) as p from sized s left join own b on b.c = s.c - s.c % {GROUP}),
steps as (select c, len(p) as n, unnest(range(0, len(p) + 1)) as d, p from whole),
nodes as (select p[1:d] as pre, d, min(c) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(c, ',' order by c) filter (where n = d), '')) as ends_sha256 from steps group by 1, 2),
kids as (select pre[1:d - 1] as pre, count(*) as n_children from nodes where d > 0 group by 1),
full_nodes as (select nodes.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * coalesce(length(pre[d].text), 0) as saved from nodes left join kids using (pre)),
sums as (select pre[1:a] as pre, count_if(n_children = 0) as n_leaves, cast(sum(saved) as bigint) as saved_tokens
    from (select *, unnest(range(0, d + 1)) as a from full_nodes) group by 1)
select f.conv_id, f.d as depth, q.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
from full_nodes f join sums using (pre) left join nodes q on f.d > 0 and q.pre = f.pre[1:f.d - 1]
"""
