"""The trie of all prefixes of conversations, built by halving depths (van Emde Boas recursion).

Sequences are rows (conv, d, label), never arrays, so a conversation of any length is spread over tasks. Going up,
neighbouring ranges of 2**k turns are paired and named by a hash of both halves. Going down, every range is cut
at half its depth: the upper half keeps the range's root, the lower half is rooted at the cut prefix, which is
named by the root and the upper half's content; all ranges of a level are cut in one job. At the last level each
turn knows the names of its prefix with and without it, and equal prefixes have equal names: grouping them gives
the nodes. Conversations with the same turns are one from the first step down, with their number.

Totals are grafted the same way: from k = 0 up, the trees below the nodes at the cut depths of a level have their
totals, and these are added to all nodes of the upper half that leads to each cut, along one conversation that
goes through it. So there are three rounds of jobs for each doubling of the greatest depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import work

#: A path is joined to the cut it leads to in parts of at most 2 ** PART turns.
PART = 12
#: Levels that go down in one job.
AT_ONCE = 4
_ROOT = "root"


def _name(*parts: Column) -> Column:
    """16 bytes that stand for ``parts`` (binary)."""
    return F.unhex(F.md5(F.concat(*parts)))


def _root() -> Column:
    return F.unhex(F.md5(F.lit(_ROOT)))


def label(role: str = "role", text: str = "text") -> Column:
    """What tells a turn: a hash of role and text, then the text's number of code points in 8 bytes; nulls are empty."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    said = F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t))
    return F.unhex(F.concat(said, F.lpad(F.hex(F.length(t).cast("long")), 16, "0")))


def _points(label: Column) -> Column:
    return F.conv(F.hex(F.substring(label, 17, 8)), 16, 10).cast("long")


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns in order as (conv, part, id, label), and (conv, part, first, before) of each part of a conversation.

    A turn's place in its conversation is ``id - first + before``. Ordering is a range sort, so the turns of one
    conversation may lie in many parts; only parts are added up. Turns of one number follow their label.
    """
    spark = turns.sparkSession
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", label().alias("label"), F.monotonically_increasing_id().alias("row"))
    order = ["conv", F.asc_nulls_first("turn"), "label", "row"]
    ranged = rows.repartitionByRange(work.slots(spark), *order).sortWithinPartitions(*order)
    items = work.written(ranged.select("conv", F.monotonically_increasing_id().alias("id"), "label"))
    items = items.withColumn("part", F.shiftright("id", 33))
    parts = items.groupBy("conv", "part").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return items, work.written(parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with its first h = crc32(c) % ``most`` turns taken from conversation c - c % ``every``.

    Returns turns (conv, d, label), d from 0, and conversations (conv, turns). All turns of the other one are taken
    if it has fewer than h, none if there is no such conversation.
    """
    items, parts = numbered(turns)
    place = F.col("id") - F.col("first") + F.col("before")
    head = items.where(F.col("conv") % every == 0).join(parts.where(F.col("before") < most - 1), ["conv", "part"]).withColumn("pos", place)
    head = head.where(F.col("pos") < most - 1)
    heads = head.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "label"))).alias("head"))
    heads = heads.select(F.col("conv").alias("giver"), F.transform("head", lambda s: s["label"]).alias("head"))
    convs = parts.groupBy("conv").agg(F.sum("n").alias("n")).withColumns({"h": F.crc32(F.col("conv").cast("string")) % most, "giver": F.col("conv") - F.col("conv") % every})
    convs = convs.join(heads, "giver", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<binary>")), F.lit(1), F.col("h").cast("int")))
    convs = work.written(convs.withColumn("given", F.size("head").cast("long")))
    own = items.join(parts.join(convs.select("conv", "h", "given"), "conv"), ["conv", "part"]).withColumn("pos", place)
    own = own.where(F.col("pos") >= F.col("h")).select("conv", (F.col("pos") - F.col("h") + F.col("given")).alias("d"), "label")
    given = convs.select("conv", F.posexplode("head").alias("d", "label")).withColumn("d", F.col("d").cast("long"))
    total = F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return work.written(own.union(given)), convs.select("conv", total.alias("turns"))


def paired(sequences: DataFrame, levels: int) -> list[DataFrame]:
    """For k = 1 to ``levels`` the halves (conv, d, left, right) of all ranges of 2**k turns; right may be missing."""
    halves, rows = [], sequences.withColumnRenamed("label", "g")
    for _ in range(levels):
        side = F.col("d").bitwiseAND(F.lit(1)) == 0
        two = rows.groupBy("conv", F.shiftright("d", 1).alias("d")).agg(F.max(F.when(side, F.col("g"))).alias("left"), F.max(F.when(~side, F.col("g"))).alias("right"))
        halves.append(work.written(two))
        rows = halves[-1].select("conv", "d", content().alias("g"))
    return halves


def content() -> Column:
    """The name of a range's content."""
    return _name(F.col("left"), F.coalesce("right", F.unhex(F.lit(""))))


def paths(halves: list[DataFrame], wholes: DataFrame) -> DataFrame:
    """conv, d, root, end, n, label and node of every turn of the conversations in ``wholes`` (conv, n).

    ``root`` names the prefix before the turn and ``end`` the one with it, null for the last turn; ``node`` is root
    and label.
    """
    rows = wholes.select("conv", F.lit(0).cast("long").alias("d"), _root().alias("root"), F.lit(None).cast("binary").alias("end"), "n")
    for k in reversed(range(len(halves))):
        both = rows.join(halves[k], ["conv", "d"])
        cut, twice = _name(F.col("root"), F.col("left")), F.col("d") * 2
        upper = F.struct(twice.alias("d"), F.col("root").alias("root"), F.when(F.col("right").isNull(), F.col("end")).otherwise(cut).alias("end"), F.col("left").alias("label"))
        lower = F.struct((twice + 1).alias("d"), cut.alias("root"), F.col("end").alias("end"), F.col("right").alias("label"))
        each = F.explode(F.when(F.col("right").isNull(), F.array(upper)).otherwise(F.array(upper, lower))).alias("half")
        rows = both.select("conv", "n", each).select("conv", "half.d", "half.root", "half.end", "n", "half.label")
        if k and k % AT_ONCE == 0:
            rows = work.written(rows)
        if k:
            rows = rows.drop("label")
    return work.written(rows.withColumn("node", _name(F.col("root"), F.col("label"))))


def nodes(path: DataFrame) -> DataFrame:
    """node, root, own (its name as a root; null without children), depth, conv, n_convs, ends (a conversation that
    ends there), n_children, and leaves and saved of the node itself."""
    last = F.col("end").isNull()
    found = path.groupBy("node").agg(
        F.first("root").alias("root"),
        F.max("end").alias("own"),
        (F.first("d") + 1).alias("depth"),
        F.min("conv").alias("conv"),
        F.sum("n").alias("n_convs"),
        F.min(F.when(last, F.col("conv"))).alias("ends"),
        F.first(_points(F.col("label"))).alias("points"),
    )
    found = work.written(found)
    children = found.groupBy(F.col("root").alias("own")).agg(F.count("*").alias("n_children"))
    # nodes without children have no key: they stay out of the join, where they would meet in one task
    counted = found.join(children, "own").unionByName(found.where("own IS NULL").withColumn("n_children", F.lit(0).cast("long")))
    leaf, saved = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), (F.col("n_convs") - 1) * F.col("points")
    return work.written(counted.withColumns({"leaves": leaf, "saved": saved}).drop("points"))


def grafted(found: DataFrame, path: DataFrame, levels: int) -> DataFrame:
    """``found`` with ``leaves`` and ``saved`` summed over each node's subtree."""
    for k in range(levels):
        at = lambda depth: depth.bitwiseAND(F.lit((2 << k) - 1)) == 1 << k
        below = found.where(at(F.col("depth") - 1)).groupBy(F.col("root").alias("own")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        cuts = found.where(at(F.col("depth")) & (F.col("n_children") > 0)).join(below, "own")
        shift = min(k, PART)
        parts = F.sequence(F.shiftright(F.col("depth") - (1 << k), shift), F.shiftright(F.col("depth") - 1, shift))
        cuts = cuts.select("conv", F.explode(parts).alias("part"), "more_leaves", "more_saved")
        turns = path.select("conv", F.shiftright("d", shift).alias("part"), "node")
        more = turns.join(cuts, ["conv", "part"]).groupBy("node").agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
        sums = {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}
        found = work.written(found.join(more, "node", "left").withColumns(sums).drop("more_leaves", "more_saved"))
    return found


def id_hashes(members: DataFrame) -> DataFrame:
    """whole and ends_sha256: the hash of the conv ids of each ``whole`` (members: whole, conv), ascending, with commas.

    Ids are sorted and joined to texts of a batch each, wherever they lie; the texts of one group then pass one
    task in order, which holds the hash's state only.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, conv = b.column("whole").to_pylist(), b.column("conv").to_pylist()
            edge = [i for i in range(len(whole)) if not i or whole[i] != whole[i - 1]] + [len(whole)]
            texts = [",".join(map(str, conv[i:j])) for i, j in zip(edge, edge[1:])]
            first = edge[:-1]
            yield pa.RecordBatch.from_arrays([pa.array([whole[i] for i in first], pa.binary()), pa.array([conv[i] for i in first], pa.int64()), pa.array(texts, pa.string())], names=["whole", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            wholes, sums = [], []
            for whole, ids in zip(b.column("whole").to_pylist(), b.column("ids").to_pylist()):
                if whole == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    wholes.append(now)
                    sums.append(state.hexdigest())
                now, state = whole, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(wholes, pa.binary()), pa.array(sums, pa.string())], names=["whole", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["whole", "ends_sha256"])

    n = work.slots(members.sparkSession)
    texts = members.select("whole", "conv").repartitionByRange(n, "whole", "conv").sortWithinPartitions("whole", "conv").mapInArrow(joined, "whole binary, first long, ids string")
    return texts.repartition(n, "whole").sortWithinPartitions("whole", "first").mapInArrow(hashed, "whole binary, ends_sha256 string")


def trie(sequences: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    ``sequences`` (conv, d, label), ``conversations`` (conv, turns); see ``prefix_trie``.
    """
    spark = sequences.sparkSession
    longest = sequences.agg(F.max("d")).first()[0]
    total = conversations.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).first()
    levels = max(1, int(longest).bit_length()) if longest is not None else 0
    turnless = conversations.where("turns = 0").select("conv", F.unhex(F.lit("")).alias("whole"))
    if levels:
        halves = paired(sequences, levels)
        members = work.written(halves[-1].select("conv", content().alias("whole")).union(turnless))
    else:
        halves, members = [], work.written(turnless)
    groups = members.groupBy("whole").agg(F.count("*").alias("n"), F.min("conv").alias("conv"))
    groups = work.written(groups.join(id_hashes(members), "whole"))
    none = hashlib.sha256(b"").hexdigest()
    ended = groups.where(F.length("whole") > 0).select(F.col("conv").alias("ends"), "ends_sha256")
    rows = [r["ends_sha256"] for r in groups.where(F.length("whole") == 0).select("ends_sha256").collect()]  # one row at most
    root = {"conv_id": total["conv"], "depth": 0, "parent_conv_id": None, "n_convs": total["n"], "n_children": 0, "n_leaves": 1, "saved_tokens": 0, "ends_sha256": (rows + [none])[0]}
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not levels:
        return spark.createDataFrame([root] if total["n"] else [], schema)
    path = paths(halves, groups.where(F.length("whole") > 0).select("conv", "n"))
    found = grafted(nodes(path), path, levels)
    top = found.where("depth = 1").agg(F.count("*"), F.sum("leaves"), F.sum("saved")).first()
    root |= dict(zip(("n_children", "n_leaves", "saved_tokens"), top))
    parents = found.where("own IS NOT NULL").select(F.col("own").alias("root"), F.col("conv").alias("parent_conv_id"))
    placed = work.hot_join(found.where("depth > 1"), parents, "root")
    placed = placed.unionByName(found.where("depth = 1").withColumn("parent_conv_id", F.lit(total["conv"])))
    ending = placed.where("ends IS NOT NULL").join(ended, "ends")
    listed = ending.unionByName(placed.where("ends IS NULL").withColumn("ends_sha256", F.lit(none))).select(
        F.col("conv").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        "ends_sha256",
    )
    return listed.unionByName(spark.createDataFrame([root], schema))


def prefix_trie(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """The nodes of all prefixes of the rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    Turns are ordered by turn, null first, then by a hash of role and text, so repeated turn numbers have a set
    order; null role or text is empty. Rows without conv_id belong to no conversation. A conversation that rebuilding
    leaves without turns is a member of the root only. No conversations give no rows; further columns are not
    looked at.
    """
    return trie(*rebuilt(turns.select("conv_id", "turn", "role", "text"), every, most))
