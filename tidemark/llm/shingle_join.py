"""N-gram Jaccard self-join by PartEnum signatures, and the groups that its links form.

Sets of word shingles whose Jaccard similarity reaches the threshold differ in few elements, at most ``T``,
a bound that follows from their sizes. For each band of sizes the hashed feature domain is cut into
partitions of three parts. Two linked sets agree, in one of the first partitions, in all but one part; so
each set emits for each of these partitions the projections on every subset of two parts, and linked sets
share a signature. How many partitions that takes is counted for each set: a partition is *usable* if the
set has features in two of its parts, and partitions are gone through in order until ``T // 2 + 1`` were
usable. (Before the first partition in which a linked pair differs at most once and that is usable for
one of them, both meet at most ``T // 2`` usable ones, so neither stops before it.) Sets without that many
usable partitions also emit their ``T + 1`` least features, which links them among themselves.

Equal sets are one class from the start. Signatures travel packed, a row for each block of texts and run of
ranges of signatures, and only those of two classes or more leave their range. Within a range 40 bits tell
them apart (a collision only costs a test). Pairs are tested on bit sketches
whose distance never exceeds the sets' difference, then on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import id_filter, memory, spans, work
from tidemark.llm.components import components
from tidemark.llm.token_counts import _large, _small

U64 = np.uint64
BLOCK_BYTES = 16 << 20
#: Ranges of signatures that travel together: a class's key is sent once for all of them, and they meet one after the other.
RUN = 4
#: Gids by which a pair finds the one group that is to test it.
FIRST = 8
#: Members of a group that one task's group holds of each side; larger groups are cut into tiles.
TILE = 4096
_K = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


@dataclass(frozen=True)
class Rule:
    """Shingle length, threshold as a fraction, and what follows from it for sets of given sizes."""

    words: int = 5
    similar: int = 80
    out_of: int = 100

    def difference(self, sizes: np.ndarray) -> np.ndarray:
        """Largest symmetric difference of linked sets whose sizes sum to ``sizes``."""
        return sizes * (self.out_of - self.similar) // (self.out_of + self.similar)

    def partner(self, size: np.ndarray) -> np.ndarray:
        """Size of the largest set that can be linked with one of ``size``."""
        return size * self.out_of // self.similar

    def edges(self, size: int) -> np.ndarray:
        """Largest size of each band, up to one that holds ``size``: partners lie in the next band at most."""
        out = [0]
        while out[-1] < size:
            out.append(int(self.partner(np.int64(out[-1] + 1))))
        return np.array(out[1:] or [1])


@dataclass
class Sets:
    """Distinct shingles of the texts of a chunk: hashes ascending within each text, ``begin`` per text."""

    shingle: np.ndarray
    begin: np.ndarray
    key: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.begin)


def shingle_sets(c: spans.Chunk, width: int) -> Sets:
    """The set of each text: ``width``-word shingles, or all its words as one if there are fewer."""
    data = spans.LOWER[c.data]
    start, end, doc = spans.words(data, c.off)
    word = spans.span_hash(data, start, end)
    count = np.bincount(doc, minlength=len(c))
    n = max(len(word) - width + 1, 0)
    roll = np.zeros(n, U64)
    for k in range(width):
        roll = roll * _K[0] + word[k : k + n]
    whole = doc[:n] == doc[width - 1 :][:n]
    short = np.flatnonzero((count > 0) & (count < width))
    first = np.cumsum(count) - count
    few = np.zeros(len(short), U64)
    for k in range(width - 1):
        has = count[short] > k
        few[has] = few[has] * _K[1] + word[first[short[has]] + k]
    few += count[short].astype(U64)
    value = spans.mix(np.concatenate([roll[whole], few]))
    owner = np.concatenate([doc[:n][whole], short])
    order = np.argsort(value)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(c) <= 1 << 16 else np.int64), kind="stable")]
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    size = np.bincount(owner, minlength=len(c))
    begin = np.concatenate(([0], np.cumsum(size)))
    total = np.zeros(len(c), U64)
    held = np.flatnonzero(size)
    if len(held):
        total[held] = np.add.reduceat(spans.mix(value + _K[2]), begin[held])
    return Sets(value, begin, spans.mix(total + size.astype(U64) * _K[3]))


def signatures(sets: Sets, which: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets ``which`` and the place in ``which`` each belongs to."""
    size = sets.size[which]
    value = spans.gather(sets.shingle, sets.begin[:-1], sets.size, which)
    owner = np.repeat(np.arange(len(which)), size)
    edges = rule.edges(int(size.max(initial=1)) * rule.out_of // rule.similar + 1)
    band = np.searchsorted(edges, size)
    out_s, out_o = [], []
    for above in (0, 1):
        join = band + above
        top = edges[join]
        most = rule.difference(size + np.minimum(top, rule.partner(size)))
        most[(rule.partner(size) <= edges[band]) & (above == 1)] = 0  # no partner in the next band
        live = most > 0
        parts = 1 + (rule.difference(2 * top) // 2 + 1) * 23 // 20
        on = np.flatnonzero(live[owner])
        if not len(on):
            continue
        v, o = value[on], owner[on]
        cell = ((v >> U64(32)) * (3 * parts[o]).astype(U64) >> U64(32)).astype(np.int64)
        run = np.ones(len(v), bool)
        run[1:] = (cell[1:] != cell[:-1]) | (o[1:] != o[:-1])
        at = np.flatnonzero(run)
        held = np.add.reduceat(spans.mix(v ^ _K[4]), at)
        run_owner, part, third = o[at], cell[at] // 3, cell[at] % 3
        new = np.ones(len(at), bool)
        new[1:] = (part[1:] != part[:-1]) | (run_owner[1:] != run_owner[:-1])
        group = np.cumsum(new) - 1
        n = group[-1] + 1
        sums, has = np.zeros((n, 3), U64), np.zeros((n, 3), bool)
        sums[group, third], has[group, third] = held, True
        g_owner, g_part = run_owner[new], part[new]
        usable = has.sum(1) >= 2
        run_up = np.cumsum(usable)
        first = np.searchsorted(g_owner, np.arange(len(which)))
        base = np.concatenate(([0], run_up))[first]
        need = most // 2 + 1
        open_ = run_up - usable - base[g_owner] < need[g_owner]
        salt = spans.mix((join[g_owner].astype(U64) * _K[1]) + g_part.astype(U64))
        total = sums.sum(1, dtype=U64)
        for left_out in range(3):
            ok = open_ & (has.sum(1) - has[:, left_out] > 0)
            out_s.append(spans.mix(total[ok] - sums[ok, left_out] + salt[ok] + U64(left_out) * _K[2]))
            out_o.append(g_owner[ok])
        reached = np.bincount(g_owner, weights=usable, minlength=len(which))
        poor = live & (reached < need)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        ok = poor[owner] & (nth <= most[owner])
        out_s.append(spans.mix(value[ok] * _K[3] + join[owner[ok]].astype(U64)))
        out_o.append(owner[ok])
    if not out_s:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(out_s), np.concatenate(out_o)


def sketch_bits(size: np.ndarray) -> np.ndarray:
    """Bits of a set's sketch: the power of two from its size on, 64 at least."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))


def sketch(values: np.ndarray) -> bytes:
    """Parity of the features at each place: sketches differ in no more bits than the sets in features."""
    m = int(sketch_bits(np.array([len(values)]))[0])
    at = (spans.mix(values + _K[4]) & U64(m - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as 64-bit words, the longer ones folded to the length of the shortest."""
    short = min(map(len, sketches))
    out = np.empty((len(sketches), short // 8), U64)
    for i, s in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(s, U64).reshape(-1, short // 8), axis=0)
    return out


def may_link(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, rule: Rule) -> np.ndarray:
    """Whether the sketches' distance leaves a link possible."""
    return np.bitwise_count(a ^ b).sum(-1) <= rule.difference(sizes)


def _packed(x: np.ndarray) -> bytes:
    """The high six bytes of each hash, in the same order."""
    return x.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(U64).ravel()


def linked(x: np.ndarray, y: np.ndarray, rule: Rule) -> bool:
    """The exact test on two ascending arrays of distinct hashes."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return rule.out_of * both >= rule.similar * (len(x) + len(y) - both)


def classes(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles and the key of the text's set, for every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in spans.chunks(b.column("text")):
                s = shingle_sets(c, rule.words)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").slice(c.first, len(c)), "n_shingles": pa.array(s.size), "class": pa.array(s.key.view(np.int64))})

    return docs.mapInArrow(memory.tidy(run), "doc_id long, n_shingles long, class long")


def shared_signatures(docs: DataFrame, rule: Rule, slots: int) -> DataFrame:
    """Groups (gid, class) of two classes or more that share a signature; equal groups have one gid."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[int, int] = {}
        got: list[tuple[np.ndarray, np.ndarray]] = []
        nbytes = 0

        def flush() -> pa.RecordBatch:
            sig, at = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, U64), np.zeros(0, np.int64))
            keys = np.fromiter(place, np.uint64, len(place))
            slot = ((sig & U64(0xFFFFFFFF)) % U64(slots)).astype(np.int64)
            order = np.argsort(slot * len(keys) + at)
            cut = np.searchsorted(slot[order], np.append(np.arange(0, slots, RUN), slots))
            rows = []
            for k in np.flatnonzero(np.diff(cut)).tolist():
                x = order[cut[k] : cut[k + 1]]
                own = np.zeros(len(keys), bool)
                own[at[x]] = True
                n, nth = own.sum(), np.cumsum(own) - 1
                held = np.bincount((slot[x] - k * RUN) * n + nth[at[x]], minlength=RUN * n)
                s = sig[x]
                rows.append({"run": k, "high": (s >> U64(32)).astype(np.uint32).tobytes(), "low": (s >> U64(24)).astype(np.uint8).tobytes(), "held": _small(held), "classes": keys[own].tobytes()})
            place.clear()
            got.clear()
            return pa.RecordBatch.from_pylist(rows, schema=packed)

        for b in batches:
            for c in spans.chunks(b.column("text")):
                s = shingle_sets(c, rule.words)
                new = []
                for i in np.flatnonzero(s.size).tolist():
                    if (k := int(s.key[i])) not in place:
                        place[k] = len(place)
                        new.append(i)
                if new:
                    sig, owner = signatures(s, np.array(new), rule)
                    got.append((sig, len(place) - len(new) + owner))
                nbytes += len(c.data)
                if nbytes >= BLOCK_BYTES:
                    yield flush()
                    nbytes = 0
        yield flush()

    def meet(table: pa.Table) -> pa.Table:
        rows = []
        for r in table.to_pylist():
            held = _large(r["held"]).reshape(RUN, -1)
            rows.append((r, held, np.concatenate(([0], np.cumsum(held.sum(1))))))
        return pa.concat_tables([meet_range(rows, i) for i in range(RUN)])

    def meet_range(rows: list[tuple[dict, np.ndarray, np.ndarray]], i: int) -> pa.Table:
        sig, own = [], []
        for r, held, cut in rows:
            n, at = int(cut[i + 1] - cut[i]), int(cut[i])
            sig.append(np.frombuffer(r["high"], np.uint32, n, 4 * at).astype(U64) << U64(8) | np.frombuffer(r["low"], np.uint8, n, at) if n else np.zeros(0, U64))
            own.append(np.repeat(np.frombuffer(r["classes"], np.int64), held[i]))
        sig, own = np.concatenate(sig), np.concatenate(own)
        order = np.argsort(sig)
        sig, own = sig[order], own[order]
        same = sig[1:] == sig[:-1]
        often = np.zeros(len(sig), bool)
        often[1:] = same
        often[:-1] |= same
        sig, own = sig[often], own[often]
        order = np.lexsort((own, sig))
        sig, own = sig[order], own[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
        sig, own = sig[new], own[new]
        if not len(sig):
            return pa.table({"gid": np.zeros(0, np.int64), "class": np.zeros(0, np.int64)})
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        n = np.diff(np.append(first, len(sig)))
        gid = spans.mix(np.add.reduceat(spans.mix(own.view(U64)), first))
        one, _ = spans.distinct_keys(gid)
        one = one[n[one] > 1]
        return pa.table({"gid": np.repeat(gid[one].view(np.int64), n[one]), "class": spans.gather(own, first, n, one)})

    packed = pa.schema([("run", pa.int32()), *((c, pa.binary()) for c in ("high", "low", "held", "classes"))])
    dealt = docs.mapInArrow(memory.tidy(deal), "run int, high binary, low binary, held binary, classes binary")
    return dealt.groupBy("run").applyInArrow(meet, "gid long, class long").distinct()


def sketches_of(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """The classes ``wanted`` (class, rep: the doc_id that stands for it, ...) with size and sketch."""
    return _of_classes(docs, wanted, wanted, rule, "sketch", sketch)


def sets_of(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """The classes ``wanted`` (class, rep; rows may repeat) with size and set (hashes as bytes)."""
    return _of_classes(docs, wanted.distinct(), wanted, rule, "set", _packed)


def _of_classes(docs: DataFrame, wanted: DataFrame, marks: DataFrame, rule: Rule, name: str, of: Callable[[np.ndarray], bytes]) -> DataFrame:
    ids = marks.where("rep IS NOT NULL").select("rep")
    bits = docs.sparkSession.sparkContext.broadcast(id_filter.marked(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(id_filter.may_hold(bits.value, b.column("doc_id")))
            for c in spans.chunks(b.column("text")):
                s = shingle_sets(c, rule.words)
                own = [of(s.shingle[x:y]) for x, y in zip(s.begin.tolist(), s.begin[1:].tolist())]
                yield pa.RecordBatch.from_pydict({"class": pa.array(s.key.view(np.int64)), "doc_id": b.column("doc_id").slice(c.first, len(c)), "size": pa.array(s.size), name: pa.array(own, pa.binary())})

    made = docs.mapInArrow(memory.tidy(run), f"class long, doc_id long, size long, {name} binary")
    found = made.join(wanted, "class").where(F.col("doc_id").eqNullSafe(F.col("rep")))
    return found.select(*wanted.columns, "size", name).dropDuplicates(["class"])


def tested(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of classes that are linked: sieved by sketches, then tested on the sets.

    Sets are made only for classes of pairs that the sieve leaves.
    """

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("size_a").to_numpy() + b.column("size_b").to_numpy()
            x, y = b.column("sketch_a").to_pylist(), b.column("sketch_b").to_pylist()
            ok = [bool(may_link(*folded([p, q]), n, rule)) for p, q, n in zip(x, y, size)]
            yield b.select(["a", "b", "rep_a", "rep_b"]).filter(pa.array(ok, pa.bool_()))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [linked(_unpacked(x.as_py()), _unpacked(y.as_py()), rule) for x, y in zip(b.column("x"), b.column("y"))]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda c: sketches.select(F.col("class").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("rep", "size", "sketch")])
    left = work.written(work.gathered(pairs.join(side("a"), "a").join(side("b"), "b")).mapInArrow(memory.tidy(sieve), "a long, b long, rep_a long, rep_b long"))
    ends = [left.select(F.col(c).alias("class"), F.col(f"rep_{c}").alias("rep")) for c in "ab"]
    sets = work.written(work.gathered(sets_of(docs, ends[0].union(ends[1]), rule)))
    whole = left.select("a", "b").join(sets.select(F.col("class").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("class").alias("a"), F.col("set").alias("x")), "a")
    return work.gathered(whole).mapInArrow(memory.tidy(test), "a long, b long")


def _least_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least number that ``x`` shares with each row of ``y``, or the largest integer."""
    return np.where((y[:, :, None] == x).any(axis=2), y, np.iinfo(np.int64).max).min(axis=1)


def open_pairs(members: DataFrame, rule: Rule, slots: int) -> DataFrame:
    """Pairs of a group with two labels that the sketches leave possible; members have gid, n (the group's), class, label, size, sketch, first.

    Two classes often share many groups; each class brings its ``FIRST`` least gids (first), and a pair is left
    to the least gid in both lists. Groups of more than ``TILE`` members are cut into tiles, and every two tiles
    meet in a task's group of their own.
    """

    def cross(table: pa.Table) -> pa.Table:
        gid, own, label, size, tile, lo, hi = (table.column(c).to_numpy() for c in ("gid", "class", "label", "size", "tile", "lo", "hi"))
        sketches, found = table.column("sketch").to_pylist(), []
        first = np.full((len(gid), FIRST), np.iinfo(np.int64).max)
        for i, own_gids in enumerate(table.column("first").to_pylist()):
            first[i, : len(own_gids)] = own_gids
        order = np.lexsort((own, tile, gid))
        for at in np.split(order, np.flatnonzero(np.diff(gid[order])) + 1):
            if len(at) < 2:
                continue
            bits = folded([sketches[i] for i in at])
            two = lo[at[0]] != hi[at[0]]
            left = int((tile[at] == lo[at[0]]).sum()) if two else len(at) - 1
            for i in range(left):
                begin = left if two else i + 1
                rest = at[begin:]
                ok = (label[rest] != label[at[i]]) & may_link(bits[i], bits[begin:], size[rest] + size[at[i]], rule)
                if ok.any():
                    ok[ok] = _least_shared(first[at[i]], first[rest[ok]]) >= gid[at[i]]
                    pair = np.stack([np.full(ok.sum(), own[at[i]]), own[rest[ok]]], 1)
                    found.append(np.sort(pair, axis=1))
        out = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": out[:, 0], "b": out[:, 1]})

    cut = members.withColumn("tiles", F.ceil(F.col("n") / TILE)).withColumn("tile", F.pmod(F.xxhash64("class"), "tiles"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select(
        "gid", "class", "label", "size", "sketch", "first", "tile", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"),
        # a group of one tile shares a slot with others; two tiles of a larger one have their own
        F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("gid"), F.lit(slots))).otherwise(F.col("gid")).alias("slot"),
    )
    return dealt.groupBy("slot", "lo", "hi").applyInArrow(cross, "a long, b long").distinct()


def near_copies(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links, itself included) of every text.

    Words are runs without ASCII white space, A-Z lowered. A null text, or one without words, has an empty
    set and is linked with nothing; a text with fewer words than a shingle has one element, all its words.
    Rows with a repeated doc_id are texts of their own; a row with a null doc_id takes part, and counts as
    the least id only where no other is reached. No rows give no rows; further columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    slots = work.slots(docs.sparkSession)
    rows = work.written(classes(docs, rule))
    by_class = rows.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("rep"))
    groups = work.written(work.gathered(shared_signatures(docs, rule, slots)))
    lists = F.slice(F.array_sort(F.collect_list("gid")), 1, FIRST).alias("first")  # a class's gids follow from its own text
    wanted = work.written(work.gathered(groups.groupBy("class").agg(F.count("*").alias("shared"), lists).join(by_class, "class")))
    sketches = work.written(work.gathered(sketches_of(docs, wanted.drop("shared"), rule)))

    # A group's hub is the class that is in most groups (a family's original, as a rule). First each class is
    # tested against the one of its hubs that is in most groups, then against all it is still apart from. Hubs
    # come before their classes in the order of places, so a linked hub is a parent; a class is labelled by its
    # parent's parent. Equal labels mean one component; unequal ones only cost a test.
    place = F.struct(-F.col("shared"), "class")
    hub = groups.join(wanted.select("class", "shared"), "class").groupBy("gid").agg(F.min(place).alias("hub"))
    to_hub = groups.join(hub, "gid").groupBy("class").agg(F.min("hub").alias("hub"))
    near = to_hub.select(F.col("class").alias("a"), F.col("hub.class").alias("b")).where("a <> b")
    links = work.written(tested(near, sketches, docs, rule))
    above = links.select(F.col("a").alias("b"), F.col("b").alias("top"))
    label = work.written(links.join(above, "b", "left").select(F.col("a").alias("class"), F.coalesce("top", "b").alias("label")))
    labelled = groups.join(label, "class", "left").select("gid", "class", F.coalesce("label", "class").alias("label"))
    apart = labelled.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    members = labelled.join(apart.select("gid", "n"), "gid").join(sketches.drop("rep"), "class")
    more = tested(open_pairs(members, rule, slots), sketches, docs, rule)
    label = components(links.union(more))

    named = by_class.join(label, by_class["class"] == label["id"], "left").select("class", "rep", F.coalesce("component", "class").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = rows.join(named.join(least, "label").select("class", "component_id"), "class", "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", alone.alias("component_id"))
