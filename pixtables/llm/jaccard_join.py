"""N-gram Jaccard join in the metric space of shingle sets, and its components.

Jaccard distance d = 1 - J is a metric. Two texts link when d <= 0.25, decided on the whole sets.

1. Equal sets are one class; from here on only classes count, copies are never paired.
2. Entry. In this space nearly all pairs of texts lie at distance 1, so pivots drawn at random
   would leave almost all texts in one void region. Each class keeps the SKETCH smallest hashes of
   its set. Linked sets share at least NEED of them (see needed(): exactly where one of the two has
   up to SKETCH shingles; two larger ones: but for a probability of 2e-12), so a class with fewer
   hashes that any other class has is alone, and the others enter the regions of their rarest
   shared hashes, all but NEED - 1 of them.
   Common passages, lines and words are the most frequent hashes and open no region.
3. Voronoi regions. Each entry goes to the pivot of its region: the class with the most shared
   hashes there, which in a family of near copies is its centre. The exact overlap with the pivot
   is measured; members within 0.25 of it are one component and need no look at each other, so a
   family of thousands costs one comparison each.
   Regions of at most LEAF classes (LATE_LEAF in the spaces of step 5, where few members are left to
   connect) are leaves of the recursion: their pairs in different components are measured at once.
4. Whole sets. Members of regions that are no leaves and still hold two components enter regions
   once more, now by the rarest shingles of their whole sets, all but 0.75 of them. Texts that have
   a passage in common, but a quarter of their own, are out; the rest meet their pivots anew.
5. Windows. For members x, y of one pivot p that are not yet connected, the triangle over p bounds
   their overlap: |x & y| <= min(|x & p|, |y & p|) + (what they share outside p). Pairs for which
   the first term and the sizes allow a link are measured at once. Other pairs must share shingles
   outside p, as many as p cannot give: the rarest of those are the regions of the next round, in
   which p itself takes no part. Rounds end when no region holds two components.

Nothing is capped, and no group is gathered: regions are aggregates and joins on their key.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pixtables.session import saved

from . import shingles

SKETCH, NEED, LEAF, LATE_LEAF = 64, 20, 24, 1024
LINK_TOP, LINK_BOTTOM = 75, 100  # LINK_BOTTOM * intersection >= LINK_TOP * union


def _sketch(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for x in it:
        n, digest, low = [], [], []
        for raw in shingles.rows(x):
            found = shingles.shingle_set(raw)  # sorted, and evenly spread numbers
            n.append(len(found))
            digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            low.append(found[:SKETCH].view(np.int64) if len(found) else None)
        yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(low, pa.list_(pa.int64()))], names=["n", "digest", "low"])


def _packed(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    for x in it:
        yield pa.array([press.compress(v.as_buffer()) if v.is_valid else None for v in x], pa.binary())


def _whole(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The shingle sets of packed texts."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    for x in it:
        yield pa.array([shingles.shingle_set(press.decompress(z.as_buffer())).view(np.int64) for z in x], pa.list_(pa.int64()))


def _overlap(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Size of the intersection of two packed texts, and, where asked, the first one's shingles outside the second."""
    import zstandard

    press, held = zstandard.ZstdDecompressor(), {}

    def unpacked(node: int, z: pa.Scalar) -> np.ndarray:
        found = held.get(node)
        if found is None:
            if len(held) >= 2000:
                held.clear()
            found = shingles.shingle_set(press.decompress(z.as_buffer()))
            if len(found) <= 4000:  # at most 64 MB are held
                held[node] = found
        return found

    for x, y, a, b, star in it:
        both, added = [], []
        for u, v, p, q, s in zip(x.to_pylist(), y.to_pylist(), a, b, star.to_pylist()):
            own, pivot = unpacked(u, p), unpacked(v, q)
            at = np.searchsorted(pivot, own)
            at[at == len(pivot)] = 0
            same = pivot[at] == own
            both.append(int(same.sum()))
            added.append(own[~same].view(np.int64) if s else None)
        yield pa.StructArray.from_arrays([pa.array(both, pa.int64()), pa.array(added, pa.list_(pa.int64()))], names=["both", "added"])


BITS = 1 << 22


def _perhaps(value: Column, among: DataFrame) -> Column:
    """False for values that are surely not among those of a one-column table.

    A table of BITS bits, whatever the number of values, is made of their hashes and broadcast;
    it spares a later join most of the rows it would shuffle in vain. A full table only spares less.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS)).cast("int")
    bits = np.zeros(BITS, bool)
    bits[among.select(place(F.col(among.columns[0])).alias("p")).distinct().toArrow().column("p").to_numpy()] = True
    held = among.sparkSession.sparkContext.broadcast(np.packbits(bits))

    @F.arrow_udf("boolean")
    def known(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = np.unpackbits(held.value).astype(bool)
        for x in it:
            yield pa.array(table[x.to_numpy(zero_copy_only=False)])

    return known(place(value))


def _sized(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """As many partitions as the rows need, so that small tables do not make hundreds of tasks and files."""
    return df.coalesce(rows // each + 8)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) for edges (a, b) of whole numbers; nodes without an edge to another are left out.

    Alternating large and small stars: each round hangs neighbours under the smallest one, until
    every node but the smallest of its component has that one as its only neighbour. The number of
    rounds grows with the logarithm of a component's length; no group is gathered.
    """
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    n = e.count()
    while True:
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if n == 0 or ends.where("up > 1 or (up > 0 and down > 0)").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        e = saved(_sized(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), n), "edges")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n, digest, low for each row: one pass over the texts, kept in the shared folder."""
    d = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.arrow_udf(_sketch, "struct<n:bigint,digest:binary,low:array<bigint>>")(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("s"))
    return saved(d.select("doc_id", "text_key", "s.*"), "sketch")


def _entries(rows: DataFrame, first: bool = False) -> DataFrame:
    """key, node, hub, need, given, rest: the regions of rows (space, node, comp, need, given, e), where e
    are the elements of a node in a space, a link needs ``need`` of them in common with the other
    node, and ``given`` more shingles at most are common outside the space.

    Elements of one component only are no way to a new link; a node with fewer others than it needs
    is out. The others enter the regions of their rarest ones, all but need - 1, so two nodes that
    can link meet. hub says how common a node's elements are for what it needs: it is greatest where
    little lies outside the common part.
    """
    several = rows.groupBy("space", "e").agg(F.count("*").alias("c"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("space", "e", "c")
    if first:
        several = saved(several, "shared")
        rows = rows.where(_perhaps(F.col("e"), several.select("e")))
    own = rows.join(several, ["space", "e"]).groupBy("space", "node").agg(F.first("need").alias("need"), F.first("given").alias("given"), F.sort_array(F.collect_list(F.struct("c", "e"))).alias("k"), (F.sum("c") / F.first("need")).alias("hub"))
    own = own.withColumn("use", (F.size("k") - F.col("need") + 1).cast("int")).where("use > 0")
    # rest: how many elements the node has from this one on, in the common order
    return own.select("space", "node", "hub", "need", "given", F.size("k").alias("all"), F.posexplode(F.slice("k", 1, F.col("use"))).alias("at", "x")).select(
        F.xxhash64("space", "x.e").alias("key"), "node", "hub", "need", "given", (F.col("all") - F.col("at")).alias("rest"))


def needed(n: Column) -> Column:
    """How many sketch entries a set of n shingles has in common with the sketch of any set it links with.

    The sketch of n <= SKETCH shingles is the whole set. A partner of m shingles shares 0.75 m or more
    with it; where m > SKETCH, its sketch lacks m - SKETCH of its own, which leaves SKETCH - m / 4, and m
    is at most n / 0.75.
    """
    whole = F.least(F.ceil(n * LINK_TOP / LINK_BOTTOM), SKETCH - F.floor(F.floor(n * LINK_BOTTOM / LINK_TOP) * (LINK_BOTTOM - LINK_TOP) / LINK_BOTTOM))
    return F.when(n <= SKETCH, whole).otherwise(NEED)


def _linked(docs: DataFrame, sketch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes: node, digest, n, doc_id, text_key of one row; links: node, comp)."""
    classes = saved(
        sketch.where(F.col("digest").isNotNull()).groupBy("digest")
        .agg(F.first("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "text_key")).alias("r"), F.first("low").alias("low"))
        .select(F.monotonically_increasing_id().alias("node"), "digest", "n", "r.doc_id", "r.text_key", "low"), "classes")
    region = saved(_entries(classes.select(F.lit(-1).cast("long").alias("space"), "node", F.col("node").alias("comp"), needed(F.col("n")).alias("need"), F.lit(0).cast("long").alias("given"), F.explode("low").alias("e")), True), "region")
    nodes = saved(region.select("node").distinct().join(classes.select("node", "n", "doc_id", "text_key"), "node"), "nodes")
    m = nodes.count()
    d = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_k"), "text")
    d = d.where(_perhaps(F.col("_k"), nodes.select("text_key")))
    packed = d.join(nodes, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")))
    # a repeated row of a class's text would only give the same numbers again
    packed = saved(packed.select("node", F.arrow_udf(_packed, "binary")(F.col("text").cast("binary")).alias("z")).dropDuplicates(["node"]), "texts")
    nodes = nodes.select("node", "n")

    def measured(pairs: DataFrame) -> DataFrame:
        """node, pivot, n, np, both, added of pairs (node, pivot, n, np, star); added only for stars."""
        both = pairs.join(packed, "node").join(packed.select(F.col("node").alias("pivot"), F.col("z").alias("zp")), "pivot")
        return saved(both.select("node", "pivot", "n", "np", F.arrow_udf(_overlap, "struct<both:bigint,added:array<bigint>>")("node", "pivot", "z", "zp", "star").alias("o")).select("node", "pivot", "n", "np", "o.*"), "overlap")

    def connected(comp: DataFrame | None, found: DataFrame) -> DataFrame:
        """Components after the links among the measured pairs are added."""
        link = found.where(LINK_BOTTOM * F.col("both") >= LINK_TOP * (F.col("n") + F.col("np") - F.col("both"))).select("node", "pivot")
        if comp is None:
            return saved(_sized(components(link.toDF("a", "b")), m), "comp")
        if link.isEmpty():
            return comp
        side = lambda old, new: comp.select(F.col("node").alias(old), F.col("comp").alias(new))
        named = link.join(side("node", "ca"), "node", "left").join(side("pivot", "cb"), "pivot", "left").select(F.coalesce("ca", "node").alias("a"), F.coalesce("cb", "pivot").alias("b"))
        up = saved(_sized(components(named), m), "up")
        fresh = up.select("node", F.col("node").alias("comp")).join(comp, "node", "left_anti")
        return saved(comp.unionByName(fresh).join(up.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")).transform(lambda x: _sized(x, m)), "comp")

    def may_link(x: str, y: str) -> Column:
        return (LINK_BOTTOM * F.least(x, y) >= LINK_TOP * F.greatest(x, y))

    comp = known = None
    level = 0  # regions of sketches, then of whole sets, then of shingles outside a pivot
    while True:
        size = region.groupBy("key").agg(F.count("*").alias("size"))
        region = region.join(size, "key")
        if comp is not None:
            region = region.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        else:
            region = region.withColumn("comp", F.col("node"))
        region = saved(_sized(region.join(nodes, "node"), 16 * m), "sized")
        # the leaves of the recursion: at most a leaf's size of pairs for each member
        leaf_size = LEAF if level < 2 else LATE_LEAF
        leaf = region.where(F.col("size") <= leaf_size)
        one = leaf.select("key", "node", "n", "comp", "need", "given", "rest")
        two = one.toDF("key", "pivot", "np", "cp", "need2", "given2", "rest2")
        # at the first element that two nodes have in common, the rest of either list bounds their overlap
        least_ = F.greatest("need", "need2")
        if level:
            least_ = F.greatest(least_, F.ceil(LINK_TOP * (F.col("n") + F.col("np")) / (LINK_TOP + LINK_BOTTOM)) - F.least("given", "given2"))
        pairs = one.join(two, "key").where((F.col("node") > F.col("pivot")) & (F.col("comp") != F.col("cp")) & may_link("n", "np") & (F.least("rest", "rest2") >= least_)).select("node", "pivot", "n", "np").distinct()
        # all others meet the pivot of their region
        wide = region.where(F.col("size") > leaf_size)
        centre = wide.groupBy("key").agg(F.max(F.struct("hub", "node", "n")).alias("p"))
        stars = wide.join(centre, "key").select("node", F.col("p.node").alias("pivot"), "n", F.col("p.n").alias("np")).where("node <> pivot").distinct()
        stars = saved(_sized(stars, m), "stars")
        pairs = pairs.join(stars.select("node", "pivot"), ["node", "pivot"], "left_anti").withColumn("star", F.lit(False)).unionByName(stars.withColumn("star", F.lit(level > 0)))
        if known is not None:
            # a pair is measured once, a star in its own direction: it needs what the member has outside the pivot
            ways = known.select("node", "pivot", F.col("added").isNotNull().alias("s")).unionByName(known.select(F.col("pivot").alias("node"), F.col("node").alias("pivot"), F.lit(False).alias("s")))
            pairs = pairs.join(ways.groupBy("node", "pivot").agg(F.max("s").alias("s")), ["node", "pivot"], "left").where("s is null or (star and not s)").drop("s")
        new = measured(pairs)
        comp = connected(comp, new)
        known = new if known is None else known.unionByName(new)
        if stars.isEmpty():
            return classes, comp
        level += 1
        if level == 1:
            named = wide.select("key", "node", "n").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            several = named.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")
            left = named.join(several, "key", "left_semi").select("node", "n", "comp").distinct().join(packed, "node")
            whole = F.explode(F.arrow_udf(_whole, "array<bigint>")("z")).alias("e")
            region = saved(_entries(left.select(F.lit(-1).cast("long").alias("space"), "node", "comp", F.ceil(F.col("n") * LINK_TOP / LINK_BOTTOM).alias("need"), F.lit(0).cast("long").alias("given"), whole)), "region")
            continue
        found = known.where("added is not null").join(stars.select("node", "pivot"), ["node", "pivot"], "left_semi")
        # pivots whose members are not yet one component
        named = found.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        several = named.groupBy("pivot").agg(F.min("comp").alias("a"), F.max("comp").alias("b"))
        several = several.where("a <> b").select("pivot")
        left = saved(_sized(named.join(several, "pivot", "left_semi"), m, 20_000), "open")
        one = left.select("pivot", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("both").alias("bx"), F.col("comp").alias("cx"))
        two = left.select("pivot", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("both").alias("by"), F.col("comp").alias("cy"))
        least = LINK_TOP * (F.col("nx") + F.col("ny"))  # (top + bottom) * intersection has to reach it
        # the member with the smaller overlap decides; the other one's size must lie in its window
        window = (F.col("cx") != F.col("cy")) & ((F.col("bx") < F.col("by")) | ((F.col("bx") == F.col("by")) & (F.col("x") < F.col("y")))) & may_link("nx", "ny") & ((LINK_TOP + LINK_BOTTOM) * F.col("bx") >= least)
        close = one.where((LINK_TOP + LINK_BOTTOM) * F.col("bx") * LINK_BOTTOM >= LINK_TOP * (LINK_BOTTOM + LINK_TOP) * F.col("nx")).join(two, "pivot").where(window)
        close = close.select(F.col("x").alias("node"), F.col("y").alias("pivot"), F.col("nx").alias("n"), F.col("ny").alias("np")).dropDuplicates(["node", "pivot"])
        seen = known.select("node", "pivot").unionByName(known.select(F.col("pivot").alias("node"), F.col("node").alias("pivot")))
        checked = measured(close.join(seen, ["node", "pivot"], "left_anti").withColumn("star", F.lit(False)))
        known = known.unionByName(checked)
        comp = connected(comp, checked)
        # what members share outside their pivot
        again = left.drop("comp").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        # a link of y needs 0.75 of y's shingles; those that the pivot cannot give are needed outside it
        need = F.greatest(F.lit(1), F.ceil(F.col("n") * LINK_TOP / LINK_BOTTOM) - F.col("both"))
        region = saved(_entries(again.select(F.col("pivot").alias("space"), "node", "comp", need.alias("need"), F.col("both").alias("given"), F.explode("added").alias("e"))), "region")


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n, node (null without words), comp and component_id for every row."""
    sketch = sketches(docs)
    classes, comp = _linked(docs, sketch)
    named = classes.select("node", "digest", "doc_id").join(comp, "node", "left").select("digest", "doc_id", F.coalesce("comp", "node").alias("comp"))
    low = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    names = named.join(low, "comp").select("digest", "comp", "component_id")
    own = sketch.select("doc_id", "text_key", "n", "digest")
    return own.join(names, "digest", "left").select("doc_id", "text_key", "n", "comp", "component_id")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_shingles, component_id for every row of docs.

    component_id is the smallest doc_id that links reach, the row's own included; null ids count
    only where a component has no other. Null and empty texts and texts without words have no
    shingles and link with nothing, repeated rows of them included. Repeated rows are repeated in
    the result. Other columns are not read; an empty table gives no rows.
    """
    return _grouped(docs).select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which one of each component stays: the one with the smallest
    doc_id (null last), of its repeated rows one. Rows without words all stay."""
    rank = F.struct(F.col("doc_id").isNull().alias("o"), F.col("doc_id").alias("d"), F.col("text_key").alias("k"))
    best = _grouped(docs).where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min(rank).alias("r"))
    best = best.select(F.col("r.o").alias("_o"), F.coalesce(F.col("r.d").cast("string"), F.lit("")).alias("_d"), F.col("r.k").alias("_k"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").isNull().alias("_o"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"), F.xxhash64("text").alias("_k"), (F.length(F.translate(F.coalesce(F.col("text"), F.lit("")), " \t\n\x0b\x0c\r", "")) > 0).alias("_words"))
    first = F.row_number().over(Window.partitionBy("_o", "_d", "_k").orderBy(F.lit(1)))
    kept = rows.where("_words").join(best, ["_o", "_d", "_k"], "left_semi").withColumn("_n", first).where("_n = 1")
    return kept.select("_row").unionByName(rows.where("not _words").select("_row")).select("_row.*")
