"""Set-similarity join on word shingles, and its connected components: heavy-light, aware of sizes.

Equal sets are one class from the start.  Two classes link when  den * |A and B| >= num * |A or B|.

Small sets: |A and B| leaves out at most s - ceil(num * s / den) elements of a set of s, so each small set enumerates its
subsets of every size that an intersection can have.  Two sets with a subset of c elements in common have an intersection of
at least c; within a key, whatever links at all links with the smallest set, so a star of links says everything.

Large sets: inverted lists over the necessary prefix of each set in one global order (rare first).  Lists of up to three members
give all their pairs.  In longer ones each set is held against its neighbour by size and against the list's first; of these
partners a set keeps the few that most of its lists name, so a group of near copies gives a bounded number of pairs for each member,
a star around few of them.  A bound from histograms of the members' leading bits drops most other pairs, and exact intersections
decide.  What these links join is one component.  In lists that still hold several, members are held against others in further
rounds, in another order each, as long as these find links (sketches of parities drop most pairs that differ too much); in the last round every member outside a list's largest component is
held against all members of other components.  So every linked pair is found, or is already joined, without all pairs of a group
of near copies.

The boundary between small and large is the one of least cost, from the histogram of set sizes.  Order: shingles that occur in
many texts of some block of the corpus come last, by their count; only their order is a hint, so the bound on their number drops
nothing.  Lists of frequent shingles are salted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec
from .common import discard, lean, only, stored, swept, tune
from .graph import components

#: Shingles in a block in which frequent ones are looked for, the count there that makes one frequent, and how many are kept.
BLOCK, FREQUENT, HINTS = 2_000_000, 8, 100_000
#: What holding two large sets against each other costs, in enumerated subsets; sets of more elements are never enumerated.
CHECK_COST, SMALL_LIMIT = 24, 39
#: Leading bits of the bins of a set's histogram, and the size from which there are more bins.
COARSE, FINE, MANY = 6, 9, 2000
#: Bits of the sketches that bound the differences of pairs inside a join, as a power of two.
SKETCH = 10
#: Members of one salted part of a list.
PART = 500
#: Partners that a set keeps from its long lists in a round, rounds at most, and one in how many pairs must link for a further
#: one.  What they leave out the last round looks at, which tries everything.
PARTNERS, TURNS, FRUITFUL = 3, 1, 4


def class_key(s: np.ndarray) -> np.uint64:
    """The key of a set: order-free, over its distinct members."""
    with np.errstate(over="ignore"):
        return np.sum(textvec.mix(s + np.uint64(0x632BE59BD9B4E019)), dtype=np.uint64)


def as_long(x) -> int:
    return int(np.uint64(x).astype(np.int64))


def least_common(size: int, num: int, den: int) -> int:
    """The fewest elements of a set of ``size`` that a linked set can share with it."""
    return -(-num * size // den)


def histogram(one: np.ndarray) -> bytes:
    """How many members have each leading bits; large sets get more bins."""
    bits = COARSE if len(one) < MANY else FINE
    return np.bincount((one >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32).tobytes()


def sketch(one: np.ndarray) -> list[int]:
    """Bits that say whether a bin holds an odd number of members; two sets differ in no fewer members than sketches in bits."""
    odd = np.bincount((one >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def most_common(x: bytes, y: bytes) -> int:
    """No intersection is larger: what two histograms have in common."""
    p, q = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
    n = min(len(p), len(q))
    return int(np.minimum(p.reshape(n, -1).sum(axis=1), q.reshape(n, -1).sum(axis=1)).sum())


def subsets(size: int, num: int, den: int) -> int:
    return sum(math.comb(size, d) for d in range(size - least_common(size, num, den) + 1))


def boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """The largest size that is enumerated, by the least total cost."""
    prefix = lambda s: s - least_common(s, num, den) + 1
    best, cost, x = 0, 0, 0
    least = None
    for x in range(0, SMALL_LIMIT + 1):
        cost = sum(n * subsets(s, num, den) for s, n in sizes.items() if 0 < s <= x) + sum(n * prefix(s) * CHECK_COST for s, n in sizes.items() if s > x)
        if least is None or cost <= least:
            best, least = x, cost
    return best


def _surveyed(k: int, separators: np.ndarray):
    """Documents -> (doc, s, node), and (hint, n) for the frequent shingles of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def frequent() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= FREQUENT
            m = int(many.sum())
            return out(pa.nulls(m, kind), np.zeros(m), np.zeros(m), found[many].astype(np.int64), n[many])

        def out(doc, s, node, hint, n, hist=None, sketches=None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([doc, pa.array(s, pa.int64()), pa.array(node, pa.int64()), pa.array(hint, pa.int64()), pa.array(n, pa.int64()), pa.array(hist or [None] * len(doc), pa.binary()), pa.array(sketches or [None] * len(doc), pa.list_(pa.int64()))], ["doc", "s", "node", "hint", "n", "hist", "sketch"])

        kind = pa.int64()
        for batch in batches:
            kind = batch.column("doc").type
            s, node, hist, sketches = [], [], [], []
            for one in textvec.shingle_sets(batch.column("text"), k, separators):
                s.append(len(one))
                hist.append(histogram(one))
                sketches.append(sketch(one))
                node.append(as_long(class_key(one)))
                if node[-1] not in seen:
                    seen.add(node[-1])
                    held.append(one)
                    size += len(one)
            zero = np.zeros(len(s), dtype=np.int64)
            yield out(batch.column("doc"), s, node, zero, zero, hist, sketches)
            if size >= BLOCK:
                yield frequent()
                held, size, seen = [], 0, set()
        if held:
            yield frequent()

    return run


def _keys(k: int, separators: np.ndarray, num: int, den: int, limit: int, hint_keys: np.ndarray, hint_counts: np.ndarray):
    """Documents -> (key, c, salt, node, s).  c: the subset's size, or 0 for a member of an inverted list; salt: 0, or from 1 on the
    part of a frequent shingle's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows: list[tuple] = []
            for one in textvec.shingle_sets(batch.column("text"), k, separators):
                s = len(one)
                if not s:
                    continue
                node = class_key(one)
                if as_long(node) in seen:
                    continue
                seen.add(as_long(node))
                least = least_common(s, num, den)
                if s <= limit:
                    mixed = textvec.mix(one + np.uint64(0x632BE59BD9B4E019))
                    with np.errstate(over="ignore"):
                        drop = [np.uint64(0)] + [np.sum(mixed[list(x)], dtype=np.uint64) for d in range(1, s - least + 1) for x in combinations(range(s), d)]
                        kept = np.concatenate([np.full(math.comb(s, d), s - d) for d in range(s - least + 1)])
                        keys = node - np.array(drop, dtype=np.uint64)
                    rows.append((keys, kept, np.zeros(len(keys), np.int64), node, s))
                if s > limit or s >= least_common(limit + 1, num, den):
                    at = np.minimum(np.searchsorted(hint_keys, one), max(0, len(hint_keys) - 1))
                    count = np.where(hint_keys[at] == one, hint_counts[at], 0) if len(hint_keys) else np.zeros(s, np.int64)
                    first = np.lexsort((one, count))[: s - least + 1]
                    parts = count[first] // PART + 1
                    salt = np.where(parts > 1, 1 + (node % parts.astype(np.uint64)).astype(np.int64), 0)
                    rows.append((one[first], np.zeros(len(first), np.int64), salt, node, s))
            if rows:
                n = [len(r[0]) for r in rows]
                columns = [np.concatenate([r[0] for r in rows]).astype(np.int64), np.concatenate([r[1] for r in rows]).astype(np.int64), np.concatenate([r[2] for r in rows]), np.repeat(np.array([r[3] for r in rows], dtype=np.uint64), n).astype(np.int64), np.repeat([r[4] for r in rows], n)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "c", "salt", "node", "s"])
            if len(seen) > 500_000:
                seen = set()

    return run


def _possible(num: int, den: int):
    """Pairs with histograms x, y -> those that can be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, p, q in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("xs").to_pylist(), batch.column("ys").to_pylist(), strict=True):
                common = most_common(x, y)
                keep.append(den * common >= num * (p + q - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                common = int((q[at] == p).sum())
                keep.append(den * common >= num * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def link(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, k: int = 5, num: int = 80, den: int = 100, separators: np.ndarray = textvec.WHITE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    Words are runs of bytes outside ``separators``, with A-Z lower-cased.  component_id is the smallest doc_id that links
    reach.  A text without words (null, empty) has no shingles and links with nothing: its component is its own id.  Equal
    texts link, so repeated rows share a component; null ids are never a component of others.  Sets are compared by 64-bit
    keys of their members.  An empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    tune(spark)
    d = only(df, **{doc_id: "doc", text: "text"})
    kind = d.schema["doc"].dataType.simpleString()
    seen = stored(d.mapInArrow(lean(_surveyed(k, separators)), f"doc {kind}, s long, node long, hint long, n long, hist binary, sketch array<bigint>"))
    docs = seen.where("n = 0").select("doc", "s", "node", "hist", "sketch")
    hints = seen.where("n > 0").groupBy("hint").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hint").limit(HINTS).toPandas().sort_values("hint", key=lambda x: x.astype("int64").to_numpy().astype(np.uint64))
    sizes = {r["s"]: r["n"] for r in docs.where(F.col("s").between(1, SMALL_LIMIT)).groupBy("s").agg(F.countDistinct("node").alias("n")).collect()}
    limit = boundary(sizes, num, den)
    make = _keys(k, separators, num, den, limit, hints["hint"].to_numpy().astype(np.int64).astype(np.uint64), hints["n"].to_numpy())
    raw = stored(d.select("text").mapInArrow(lean(make), "key long, c long, salt long, node long, s long"))
    several = raw.groupBy("key", "c").agg(F.min("node").alias("p"), F.max("node").alias("q")).where("p <> q")
    keys = stored(raw.join(several, ["key", "c"], "left_semi").distinct())
    discard(raw)

    # Small sets: stars around the smallest member of each key.
    small = keys.where("c > 0")
    star = small.groupBy("key", "c").agg(F.min(F.struct("s", "node")).alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "c", F.col("least.s").alias("s0"), F.col("least.node").alias("a"))
    fits = den * F.col("c") >= num * (F.col("s") + F.col("s0") - F.col("c"))
    links = small.join(star, ["key", "c"]).where((F.col("node") != F.col("a")) & fits).select("a", F.col("node").alias("b"))

    # Large sets: neighbours and first members of each part of a list, then the parts' first members and the list's.
    lists = keys.where("c = 0").select("key", "salt", "node", "s")
    part = Window.partitionBy("key", "salt")
    by_size = part.orderBy("s", "node")
    who = F.struct("node", "s")
    placed = lists.select("*", F.lag(who).over(by_size).alias("before"), F.first(who).over(by_size).alias("first"), F.count("*").over(part).alias("n"))
    placed = placed.select("node", "s", "before", "first", ((F.col("salt") == 0) & (F.col("n") <= 3)).alias("all"))
    heads = lists.where("salt > 0").groupBy("key", "salt").agg(F.min(F.struct("s", "node")).alias("h"))
    heads = heads.join(heads.groupBy("key").agg(F.min("h").alias("f")), "key").select("h.node", "h.s", F.lit(None).alias("before"), F.struct("f.node", "f.s").alias("first"), F.lit(False).alias("all"))
    near = lambda p, q: den * F.least(p, q) >= num * F.greatest(p, q)
    other = placed.union(heads).select("node", "s", "all", F.explode(F.array("before", "first")).alias("o")).where("o is not null and o.node <> node")
    other = other.where(near(F.col("o.s"), F.col("s")) & ((F.col("s") > limit) | (F.col("o.s") > limit)))
    named = other.groupBy("node", F.col("o.node").alias("o")).agg(F.max("all").alias("all"), F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("node", "all").orderBy(F.desc("n"), "o"))
    first = named.withColumn("r", best).where(F.col("all") | (F.col("r") <= PARTNERS)).select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b"))
    tried = stored(first.distinct())
    classes = stored(docs.where("s > 0").groupBy("node").agg(F.min("doc").alias("least"), F.first("s").alias("s"), F.first("hist").alias("hist"), F.first("sketch").alias("sketch")))
    nameless = not classes.where("least is null").isEmpty()

    def verified(pairs: DataFrame) -> DataFrame:
        ends = lambda p: p.select(F.col("a").alias("node")).union(p.select(F.col("b").alias("node"))).distinct()
        known = stored(classes.join(ends(pairs), "node", "left_semi").select("node", "s", "hist"))
        x = known.select(F.col("node").alias("a"), F.col("hist").alias("x"), F.col("s").alias("xs"))
        y = known.select(F.col("node").alias("b"), F.col("hist").alias("y"), F.col("s").alias("ys"))
        likely = stored(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "xs", "ys").mapInArrow(lean(_possible(num, den)), "a long, b long"))
        ids = classes.join(ends(likely), "node", "left_semi").select("node", F.col("least").alias("doc"))
        # An id can stand for several texts, so a set also has to have the key it is wanted for.
        found = d.join(ids, "doc").select("node", "text").mapInArrow(lean(_sets_of(k, separators)), "node long, members binary")
        if nameless:  # sets that only rows without an id have are looked for among these by their own keys
            own = d.where("doc is null").select(F.lit(None).cast("long").alias("node"), "text").mapInArrow(lean(_sets_of(k, separators)), "node long, members binary")
            found = found.unionByName(own.join(ids.where("doc is null").select("node"), "node", "left_semi"))
        have = stored(found.dropDuplicates(["node"]))
        both = likely.join(have.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(have.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
        out = stored(both.select("a", "b", "x", "y").mapInArrow(lean(_linked(num, den)), "a long, b long"))
        discard(known, likely, have)
        swept(spark)
        return out

    roots = components(links.union(verified(tried)))
    asked, turn = [tried], 0
    while True:
        rest = stored(_unsettled(lists, roots, classes))
        apart = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)
        # With d members apart, two sets of xs + ys members have (xs + ys - d) / 2 in common and (xs + ys + d) / 2 in all.
        may = lambda xs, x, ys, y: near(xs, ys) & ((xs > limit) | (ys > limit)) & (den * (xs + ys - apart(x, y)) >= num * (xs + ys + apart(x, y)))
        pairs = _neighbours(rest, turn, may) if turn >= 0 else _others(rest, may)
        for old in asked:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        n = pairs.count()
        new = verified(pairs) if n else pairs
        discard(rest)
        if n:
            links_found = new.count()
            few = links_found * FRUITFUL < n
            if links_found:
                joined = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new))
                discard(roots)
                roots = joined
            discard(new)
        asked.append(pairs)
        if turn < 0:
            break
        turn = -1 if not n or few or turn + 1 == TURNS else turn + 1
    discard(keys, *asked)
    whole = classes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = whole.join(whole.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", "component")
    out = docs.drop("hist", "sketch").join(named, "node", "left")
    return out.select(F.col("doc").alias(doc_id), F.col("s").alias("n_shingles"), F.when((F.col("s") > 0) & F.col("component").isNotNull(), F.col("component")).otherwise(F.col("doc")).alias("component_id"))


def _unsettled(lists: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of lists that hold several components, with their components and the list's largest (main).

    Of an unsalted list of up to three members all pairs have been tried.  ``salts`` are the parts of the list.
    """
    salts = F.sequence(F.least("high", F.lit(1)), "high").alias("salts")
    long_lists = lists.groupBy("key").agg(F.count("*").alias("n"), F.max("salt").alias("high")).where("n > 3 or high > 0 and n > 1").select("key", salts)
    of = lists.join(long_lists.select("*", F.explode("salts").alias("salt")), ["key", "salt"]).join(roots, "node", "left").select("key", "salt", "salts", "node", "s", F.coalesce("root", "node").alias("root"))
    several = of.groupBy("key", "salts", "root").agg(F.count("*").alias("n")).groupBy("key", "salts").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main")).where("roots > 1")
    return of.join(several.select("key", F.explode("salts").alias("salt"), "main"), ["key", "salt"]).join(classes.select("node", "sketch"), "node")


def _neighbours(rest: DataFrame, turn: int, may) -> DataFrame:
    """(a, b): members and the one before them in a list, if in another component; for each member the PARTNERS that most of its
    lists name.  Every turn deals a list's members to parts anew, and puts them in another order."""
    deal = F.xxhash64(F.lit(turn), "node")
    order = Window.partitionBy("key", F.pmod(deal, F.size("salts"))).orderBy(F.xxhash64(deal), "node")
    met = rest.withColumn("o", F.lag(F.struct("node", "s", "root", "sketch")).over(order)).where("o is not null and o.root <> root")
    named = met.where(may(F.col("s"), F.col("sketch"), F.col("o.s"), F.col("o.sketch"))).groupBy("node", F.col("o.node").alias("o")).agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "o"))
    return named.withColumn("r", best).where(F.col("r") <= PARTNERS).select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b")).distinct()


def _others(rest: DataFrame, may) -> DataFrame:
    """(a, b): every member outside its list's largest component and every member of another component in the list.

    Such a member meets each part of its list where that part lies.  What cannot be linked is left out inside the join.
    """
    minor = rest.where("root <> main").select("key", F.explode("salts").alias("salt"), F.col("node").alias("p"), F.col("s").alias("ps"), F.col("root").alias("pr"), F.col("sketch").alias("psketch"))
    other = (F.col("pr") != F.col("root")) & ((F.col("root") == F.col("main")) | (F.col("p") < F.col("node")))
    both = minor.join(rest, ["key", "salt"]).where(other & may(F.col("s"), F.col("sketch"), F.col("ps"), F.col("psketch")))
    return both.select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")).distinct()


def _sets_of(k: int, separators: np.ndarray):
    """(node, text) -> (node, members), for texts whose set has the key ``node``; where that is null, for every text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = zip(batch.column("node").to_pylist(), textvec.shingle_sets(batch.column("text"), k, separators), strict=True)
            found = [(own, s.tobytes()) for n, s in each if len(s) and ((own := as_long(class_key(s))) == n or n is None)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], ["node", "members"])

    return run
