"""Merkle manifest of a dataset: a tree of 16-ary runs per source, and one over the sources' roots.

A leaf's place in its source is a rank query: every source has a bitmap of its document ids, kept as
words of 64 ids and only where an id is set, so that sparse ids cost no empty words. Tasks make words of
their own rows and Spark merges them by bit-or before and after the shuffle. Containers of 16 words carry
a directory of popcounts, the containers' own counts are summed level by level in nodes of 256, and a
row's place is base + directory + popcount of its word below its bit. Leaves are never sorted.

Levels are reduced by keyed slots: nodes of a run go to (source, run) with their slot as the key of a map,
which is read out slot by slot. Sibling hashes then travel down the written levels to the leaves.

Rows with a null id come first in their source. Rows that share an id in a source are leaves of
their own, ordered by their hash; equal rows are interchangeable and share out the places of their group.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save
from .numbering import numbered

ARITY_BITS = 4  # nodes of a run: 16
WORD_BITS, CONTAINER_BITS = 6, 4  # ids of a word, words of a container
FAN_BITS = 8  # children of a directory node
STEP = 65536  # large groups of equal rows open in two steps
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """Lower-case hex SHA-256 of the fields in a row."""
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def _grouped(docs: DataFrame, group: str, ident: str, digest: Column, carry: dict[str, Column]) -> DataFrame:
    """Distinct rows (g, doc_id, leaf, carried columns, n): ``g`` is the group as a text that is never null and
    sorts as the group does with null first; ``n`` counts equal rows."""
    g = F.when(F.col(group).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(group).cast("string")))
    named = [g.alias("g"), F.col(ident).cast("long").alias("doc_id"), digest.alias("leaf"), *[c.alias(k) for k, c in carry.items()]]
    return docs.select(*named).groupBy("g", "doc_id", "leaf", *carry).agg(F.count("*").alias("n"))


def _low(at: Column, bits: int) -> Column:
    return at.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _prefix(nodes: DataFrame, levels: int) -> DataFrame:
    """Nodes (g, at, n) with ``before``: the rows of all nodes of ``g`` below ``at``. ``levels`` directory
    levels of 256 children lead to one node per group; a task holds the children of one node at a time."""
    if not levels:
        return nodes.withColumn("before", F.lit(0).cast("long"))
    kids = save(nodes.groupBy("g", F.shiftright("at", FAN_BITS).alias("up")).agg(F.collect_list(F.struct("at", "n")).alias("kids"), F.sum("n").alias("n")), "directory")
    held = _prefix(kids.select("g", F.col("up").alias("at"), "n"), levels - 1).select("g", F.col("at").alias("up"), F.col("before").alias("base"))
    inside = lambda k: F.aggregate(F.filter("kids", lambda v: v["at"] < k["at"]), F.col("base"), lambda s, v: s + v["n"])
    opened = F.transform("kids", lambda k: F.struct(k["at"].alias("at"), k["n"].alias("n"), inside(k).alias("before")))
    return kids.drop("n").join(held, ["g", "up"]).select("g", F.explode(opened).alias("k")).select("g", "k.*")


def _levels(least: int, most: int) -> int:
    """Directory levels until the numbers from ``least`` to ``most`` share one node."""
    n = 0
    while least != most:
        least, most, n = least >> FAN_BITS, most >> FAN_BITS, n + 1
    return n


def coordinates(rows: DataFrame) -> DataFrame:
    """Rows (g, doc_id, leaf, n and more; distinct) with ``idx``, the first of their places in ``g``, and
    ``total``, the rows of ``g``: rank queries against the group's bitmap."""
    least, most = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    none = 0 if least is None else max(least - 1, -(2**63))  # where rows without an id stand
    # with the sign bit turned, ids are in the order of unsigned numbers, so that all share a node in the end
    rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(none).cast("long")).bitwiseXOR(F.lit(-(2**63))))
    word = F.shiftrightunsigned("at", WORD_BITS)
    bit = F.expr(f"shiftleft(1L, cast(at & {(1 << WORD_BITS) - 1} as int))")
    words = save(rows.groupBy("g", word.alias("word")).agg(F.bit_or(bit).alias("bits"), F.sum("n").alias("n")), "bitmap-words")
    crowded = words.filter("n > bit_count(bits)").select("g", "word")
    if crowded.isEmpty():
        rows = rows.withColumn("tie", F.lit(0).cast("long"))
        words = words.withColumn("more", F.expr("cast(array() as array<struct<low:int,extra:bigint>>)"))
    else:
        # ids of several rows: their bit counts once, the others are listed with the word
        same = rows.withColumn("word", word).join(crowded, ["g", "word"], "left_semi")
        ahead = Window.partitionBy("g", "at").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
        ties = same.withColumn("tie", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select("g", "at", "leaf", "tie")
        extra = same.groupBy("g", "word", "at").agg((F.sum("n") - 1).alias("extra")).filter("extra > 0")
        listed = extra.groupBy("g", "word").agg(F.collect_list(F.struct(_low(F.col("at"), WORD_BITS).alias("low"), "extra")).alias("more"))
        words = words.join(listed, ["g", "word"], "left").withColumn("more", F.coalesce("more", F.array().cast("array<struct<low:int,extra:bigint>>")))
        rows = rows.join(ties, ["g", "at", "leaf"], "left").withColumn("tie", F.coalesce("tie", F.lit(0)))

    entry = F.struct(_low(F.col("word"), CONTAINER_BITS).alias("no"), "bits", "n", "more")
    held = words.groupBy("g", F.shiftright("word", CONTAINER_BITS).alias("c")).agg(F.collect_list(entry).alias("ws"), F.sum("n").alias("n"))
    below = lambda w: F.aggregate(F.filter("ws", lambda v: v["no"] < w["no"]), F.lit(0).cast("long"), lambda s, v: s + v["n"])
    directory = F.transform("ws", lambda w: F.struct(w["no"].alias("no"), w["bits"].alias("bits"), w["more"].alias("more"), below(w).alias("before")))
    held = save(held.select("g", "c", "n", directory.alias("ws")), "bitmaps")
    ends = ((x + 2**63) >> (WORD_BITS + CONTAINER_BITS) for x in (none, none if most is None else most))
    bases = _prefix(held.select("g", F.col("c").alias("at"), "n"), _levels(*ends))
    totals = held.groupBy("g").agg(F.sum("n").alias("total"))
    bitmaps = held.drop("n").join(bases.select("g", F.col("at").alias("c"), F.col("before").alias("base")), ["g", "c"]).join(totals, "g")

    low = _low(F.col("at"), WORD_BITS)
    asked = rows.withColumn("c", F.shiftrightunsigned("at", WORD_BITS + CONTAINER_BITS)).join(bitmaps, ["g", "c"])
    own = asked.withColumn("w", F.filter("ws", lambda w: w["no"] == _low(F.shiftrightunsigned("at", WORD_BITS), CONTAINER_BITS))[0]).drop("ws")
    under = F.bit_count(F.expr(f"w.bits & ~shiftleft(-1L, cast(at & {(1 << WORD_BITS) - 1} as int))"))
    extras = F.aggregate(F.filter("w.more", lambda m: m["low"] < low), F.lit(0).cast("long"), lambda s, m: s + m["extra"])
    return own.withColumn("idx", F.col("base") + F.col("w.before") + under + extras + F.col("tie")).drop("c", "w", "base", "tie", "at")


def _nodes(total: Column, level: int) -> Column:
    """Nodes of a group of ``total`` leaves on a level."""
    size = 1 << (ARITY_BITS * level)
    return F.floor((total + (size - 1)) / size).cast("long")


def _depth(total: int) -> int:
    """Reductions until one node is left."""
    n = 0
    while total > 1:
        total, n = -(-total // (1 << ARITY_BITS)), n + 1
    return n


def _slots(item: Column) -> Column:
    """The children of a run by slot: a keyed map, read out from 0."""
    slots = F.map_from_entries(F.collect_list(F.struct(_low(F.col("idx"), ARITY_BITS).alias("slot"), item.alias("item"))))
    return F.transform(F.sequence(F.lit(0), F.size(slots) - 1), lambda i: slots[i])


def levels(leaves: DataFrame, most: int, name: str) -> list[DataFrame]:
    """Written levels (g, total, at, slots, h) of the trees over ``leaves`` (g, total, idx, item: a struct with
    ``leaf``), from the leaves' runs up to the roots of the largest group, which has ``most`` leaves. A group of
    one leaf has a first level of that leaf alone, unhashed."""
    run = F.shiftright("idx", ARITY_BITS).alias("at")
    first = leaves.groupBy("g", "total", run).agg(_slots(F.col("item")).alias("slots"))
    hashed = F.sha2(F.array_join(F.transform("slots", lambda s: s["leaf"]), ""), 256)
    first = first.withColumn("h", F.when(F.col("total") > 1, hashed).otherwise(F.col("slots")[0]["leaf"]))
    out = [save(first, f"{name}-1")]
    for level in range(1, _depth(most)):
        below = out[-1].filter(_nodes(F.col("total"), level) > 1).withColumn("idx", F.col("at"))
        up = below.groupBy("g", "total", run).agg(_slots(F.col("h")).alias("slots"))
        out.append(save(up.withColumn("h", F.sha2(F.array_join("slots", ""), 256)), f"{name}-{level + 1}"))
    return out


def _is_root(level: int) -> Column:
    """Of a row of a level: nothing stands above it in its group."""
    return _nodes(F.col("total"), level) == 1


def roots(trees: list[DataFrame]) -> DataFrame:
    """(g, total, h) of every group."""
    found = [t.filter(_is_root(i)).select("g", "total", "h") for i, t in enumerate(trees, 1)]
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0]


def _beside(hashes: Column, i: Column) -> Column:
    """What stands left and right of child ``i`` of a run."""
    return F.struct(F.array_join(F.slice(hashes, F.lit(1), i), "").alias("left"), F.array_join(F.slice(hashes, i + 2, F.size(hashes)), "").alias("right"))


def descend(trees: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Leaves with the path from them to the top: (g, item, path, the other columns of ``tops``). ``tops``
    (g, path and more) has the path above each group's root. A level's rows meet the paths of their nodes by
    (g, place) and hand them on to their children, so a path is made once for 16 nodes."""
    known = None
    for level in range(len(trees), 0, -1):
        rows = trees[level - 1]
        own = rows.filter(_is_root(level)).join(tops, "g")
        if known is not None:
            own = own.unionByName(rows.filter(~_is_root(level)).join(known, ["g", "at"]), allowMissingColumns=False)
        hashes = F.transform("slots", lambda s: s["leaf"]) if level == 1 else F.col("slots")
        more = [c for c in tops.columns if c not in ("g", "path")]
        opened = own.select("g", "total", "at", "path", *more, hashes.alias("hashes"), F.posexplode("slots").alias("i", "item"))
        step = F.concat(F.array(_beside(F.col("hashes"), F.col("i"))), F.col("path"))
        path = F.when(F.col("total") > 1, step).otherwise(F.col("path")).alias("path")
        known = opened.select("g", (F.col("at") * (1 << ARITY_BITS) + F.col("i")).alias("at"), "item", path, *more)
        if level > 1:
            known = known.drop("item")
    return known


def fold(path: Column, start: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, group: str, ident: str, digest: Column, **carry: Column) -> DataFrame:
    """A row per row of ``docs``: doc_id, leaf, the carried columns, path, subroot, root."""
    rows = save(_grouped(docs, group, ident, digest, carry), "leaves")
    most = rows.groupBy("g").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    item = F.struct("leaf", "doc_id", *carry)
    spread = (
        coordinates(rows)
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STEP).cast("long"))))
        .withColumn("i", F.explode(F.sequence(F.col("part") * STEP, F.least(F.col("n"), (F.col("part") + 1) * STEP) - 1)))
        .select("g", "total", (F.col("idx") + F.col("i")).alias("idx"), item.alias("item"))
    )
    trees = levels(spread, most, "runs")
    # the sources' roots are the leaves of one more tree
    subroots = numbered(roots(trees).select(F.col("g").alias("source_key"), F.col("h").alias("leaf")), [F.col("source_key")], "subroots", "idx")
    n = subroots.count()
    above = levels(subroots.select(F.lit("all").alias("g"), F.lit(n).cast("long").alias("total"), "idx", F.struct("leaf", "source_key").alias("item")), n, "source-runs")
    top = roots(above).select("g", F.col("h").alias("root"), F.array().cast(PATH).alias("path"))
    tops = descend(above, top).select(F.col("item.source_key").alias("g"), F.col("item.leaf").alias("subroot"), "root", "path")
    return descend(trees, save(tops, "source-paths")).select("item.*", "path", "subroot", "root")


def audited(docs: DataFrame) -> DataFrame:
    """Manifest of ``documents``, and its check against altered rows: where 5 divides the CRC-32 of the
    decimal doc_id, the text's A-Z are lower-cased before its leaf is made anew. Columns: doc_id, leaf,
    subroot, root, proof_sha256 (all untouched), folded_root (from the altered, else the original leaf, and
    the original siblings) and verified (equals root). Rows without an id aren't altered."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    altered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    same = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    other = F.when(altered, leaf(*same, F.translate("text", upper, upper.lower())))
    rows = manifest(docs, "source", "doc_id", leaf(*same, F.col("text")), other=other)
    folded = fold(F.col("path"), F.coalesce("other", "leaf"))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
