"""Prefix trie of conversations by leaf-peeling message passing.

Each distinct sequence of a conversation's first d turns is a node; its members are the conversations that
start with it. A node's identity is its depth with two 64-bit words, the exclusive or over its turns of
hashes of (position, role, text), so that prefixes are running sums, which a window computes in
segments of SEGMENT turns: one conversation may hold most of the rows.

Subtree totals are found by peeling. The nodes fall into runs down the trie: a run is the nodes
with the same longest member (of equal ones the smallest id), from where it parts from a longer one to its end. A run holds a counter
of the runs that hang from it and are not complete. In each round complete runs send the totals of
their subtrees to their parents; the messages are summed before the shuffle; a run whose counter
falls to zero is complete in the next round, until only the root's run finishes. Rounds are as many as runs
are nested, at most the root of twice the number of nodes, and few in practice, not as many as the trie is deep.
Within the runs, totals of the nodes are running sums from the end.

Conversations are rebuilt first: the head of conversation c - c % 20 (its first h turns, h of c by a hash) and
c's own turns after its first h. ``trie`` takes (conv_id, depth, role, digest, n_words) in any case, so that
other conversations need no rebuilding.

Defined results: turns are ordered by turn (null first), then role, then SHA-256 of the text, so ties have one order and
repeated rows are turns of their own; a null role or text is an empty one; rows with a null conv_id belong to no
conversation; a conversation may be left without turns and is a member of the root; very long texts are
hashed once and never shuffled; other columns are ignored, whatever their names; an empty table gives no node.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline.functions.ordered_digest import ordered_sha256
from tessaline.llm.common import cut
from tessaline.llm.quality_rules import words_of

FAMILY, HEADS = 20, 4  # conversations that share a head, and lengths of heads from 0
SEGMENT = 1024  # turns that one task sums
HOT_ENDS = 1000  # members that end in a node beyond which they are hashed in chunks
KEY = ["depth", "x", "y"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n_words) of the rows that have a conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).filter("conv_id IS NOT NULL")
    return rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), F.size(words_of(F.col("text"))).alias("n_words"))


def ranked(turns: DataFrame) -> DataFrame:
    """turns with rank from 1. Turns are dealt by ranges, so that a long conversation is spread; what a conversation has in earlier ranges is added, one row for each range at most."""
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("digest")]
    dealt = turns.withColumn("row", F.monotonically_increasing_id())  # deals equal rows as well
    dealt = cut(dealt.repartitionByRange("conv_id", *order, "row").withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("conv_id", "part", F.sum("n").over(earlier).alias("before")).filter("before > 0")
    own = dealt.withColumn("own", F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order)))
    found = own.join(F.broadcast(before), ["conv_id", "part"], "left")  # a range continues one conversation at most
    return found.withColumn("rank", F.col("own") + F.coalesce("before", F.lit(0))).drop("turn", "row", "part", "own", "before")


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of every conversation, and (conv_id, depth, role, digest, n_words) of their turns, with the heads of their families."""
    rows = cut(ranked(turns_of(conversations)))
    found = rows.groupBy("conv_id").agg(F.max("rank").alias("turns")).withColumn("h", head_length(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    heads = rows.filter((F.col("rank") < HEADS) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    sizes = heads.groupBy("base").agg(F.max("rank").alias("has"))
    found = found.join(sizes, "base", "left").withColumn("head", F.least("h", F.coalesce("has", F.lit(0))))
    found = cut(found.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("length")))
    values = ["role", "digest", "n_words"]
    shared = found.filter("head > 0").join(heads, "base").filter("rank <= head").select("conv_id", F.col("rank").alias("depth"), *values)
    own = rows.withColumn("h", head_length(F.col("conv_id"))).filter("rank > h")
    moved = found.filter("head < h").select("conv_id", (F.col("h") - F.col("head")).alias("short"))
    own = own.join(moved, "conv_id", "left").select("conv_id", (F.col("rank") - F.col("h") + F.col("h") - F.coalesce("short", F.lit(0))).alias("depth"), *values)
    return found.select("conv_id", "length"), shared.unionByName(own)


def running(rows: DataFrame, key: str, at: str, values: dict[str, str], total: Callable[[str], Column], join: Callable[[Column, Column], Column], down: bool = False) -> DataFrame:
    """rows with running totals (name: column) over at, ascending or descending, within key. Segments are summed by themselves, then the totals of earlier segments are added, so no task holds a long key."""
    names = list(values)
    rows = rows.withColumn("_seg", F.floor(F.col(at) / SEGMENT))
    by = (lambda c: F.desc(c)) if down else (lambda c: F.asc(c))
    upto = Window.partitionBy(key, "_seg").orderBy(by(at)).rowsBetween(Window.unboundedPreceding, 0)
    long = rows.filter("_seg > 0").select(key).distinct()
    sums = rows.join(long, key, "left_semi").groupBy(key, "_seg").agg(*[total(c).alias(f"_{n}") for n, c in values.items()])
    earlier = Window.partitionBy(key).orderBy(by("_seg")).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(key, "_seg", *[total(f"_{n}").over(earlier).alias(f"_c{n}") for n in names])
    local = rows.select("*", *[total(c).over(upto).alias(f"_{n}") for n, c in values.items()])
    local = local.join(carried, [key, "_seg"], "left")
    own = [c for c in rows.columns if c not in (*names, "_seg")]
    return local.select(*own, *[join(F.col(f"_{n}"), F.coalesce(f"_c{n}", F.lit(0))).alias(n) for n in names])


def prefixes(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, length, depth, x, y, px, py, n_words): the node of each prefix and its parent's words, the root included."""
    hashed = lambda salt: F.xxhash64(F.lit(salt), F.col("depth").cast("long"), "role", "digest")
    rows = turns.select("conv_id", F.col("depth").cast("long").alias("depth"), "n_words", hashed("one").alias("a"), hashed("two").alias("b"))
    rows = running(rows, "conv_id", "depth", {"x": "a", "y": "b"}, F.bit_xor, lambda p, q: p.bitwiseXOR(q))
    rows = rows.select("conv_id", "depth", "x", "y", F.col("x").bitwiseXOR(F.col("a")).alias("px"), F.col("y").bitwiseXOR(F.col("b")).alias("py"), "n_words")
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv_id", zero.alias("depth"), zero.alias("x"), zero.alias("y"), F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"), F.lit(0).alias("n_words"))
    return rows.join(lengths, "conv_id").unionByName(roots.join(lengths, "conv_id"))


def nodes_of(members: DataFrame) -> DataFrame:
    """(depth, x, y, px, py, conv_id, n_convs, n_ends, n_words, run): run is the longest member, of equal ones the smallest."""
    ends = F.count_if(F.col("depth") == F.col("length"))
    longest = F.max(F.struct("length", F.bitwise_not("conv_id").alias("least")))["least"]
    return members.groupBy(*KEY).agg(F.min("px").alias("px"), F.min("py").alias("py"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), ends.alias("n_ends"), F.min("n_words").alias("n_words"), F.bitwise_not(longest).alias("run"))


def family(nodes: DataFrame) -> DataFrame:
    """nodes with n_children, and the conv_id and run of the parent."""
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    parents = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"), F.col("run").alias("parent_run"))
    return cut(nodes.join(parents, ["depth", "px", "py"], "left"))


def peel(runs: DataFrame) -> DataFrame:
    """(run, parent, at, leaves, saved): totals of the subtree of each run's top, from the runs' own values, their parent run and the depth at which they hang."""
    waiting = runs.groupBy(F.col("parent").alias("run")).agg(F.count("*").alias("waiting")).filter("run IS NOT NULL")
    state = cut(runs.join(waiting, "run", "left").withColumn("waiting", F.coalesce("waiting", F.lit(0))))
    finished = []
    while True:
        complete = state.filter("waiting = 0")
        finished.append(complete.drop("waiting"))
        left = state.filter("waiting > 0")
        sent = complete.groupBy(F.col("parent").alias("run")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"), F.count("*").alias("_n"))
        none = F.lit(0)
        state = left.join(sent, "run", "left").select("run", "parent", "at", *[(F.col(c) + F.coalesce(m, none)).alias(c) for c, m in (("leaves", "_l"), ("saved", "_s"))], (F.col("waiting") - F.coalesce("_n", none)).alias("waiting"))
        state = cut(state)
        if state.isEmpty():
            return reduce(DataFrame.unionByName, finished)


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """nodes with n_leaves and saved_tokens."""
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("n_words")
    nodes = nodes.withColumn("leaves", leaf).withColumn("saved", saved)
    top = ~F.col("parent_run").eqNullSafe(F.col("run"))
    runs = nodes.groupBy("run").agg(F.max(F.when(top, F.col("parent_run"))).alias("parent"), (F.min("depth") - 1).alias("at"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    hung = peel(cut(runs)).filter("parent IS NOT NULL").groupBy(F.col("parent").alias("run"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
    whole = nodes.join(hung, ["run", "depth"], "left").withColumn("leaves", F.col("leaves") + F.coalesce("_l", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("_s", F.lit(0)))
    return running(whole, "run", "depth", {"n_leaves": "leaves", "saved_tokens": "saved"}, F.sum, lambda p, q: p + q, down=True)


def end_hashes(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) of the nodes in which conversations end."""
    ends = members.filter("depth = length").select(*KEY, F.col("conv_id"))
    hot = nodes.filter(F.col("n_ends") > HOT_ENDS).select(*KEY)
    few = ends.join(hot, KEY, "left_anti").groupBy(*KEY).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    few = few.select(*KEY, F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ends_sha256"))
    many = ends.join(hot, KEY, "left_semi")
    if hot.isEmpty():
        return few
    return few.unionByName(ordered_sha256(many, KEY, [F.col("conv_id")], F.col("conv_id").cast("string"), ",").withColumnRenamed("sha256", "ends_sha256"))


def trie(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, n_ends."""
    members = cut(prefixes(lengths, turns))
    nodes = family(nodes_of(members))
    hashes = end_hashes(members, nodes)
    out = subtree_totals(nodes).join(hashes, KEY, "left")
    long = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return out.select(*long, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.col("n_ends").cast("long").alias("n_ends"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(*rebuild(conversations))
