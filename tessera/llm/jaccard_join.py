"""N-gram Jaccard join with adaptive multi-match prefixes.

Two texts link when the Jaccard similarity of their sets of word shingles reaches a threshold.
Under one order of all shingles, a set's prefix of ``n - ceil(t n) + l`` shingles shares at
least ``l`` with that of every set it links with; a longer prefix asks for more shared ones.

1. Texts with one and the same set form a class and are compared once.
2. By hash order, every set's prefix with ``l`` of ``EXTRA`` percent of its size: sets with
   fewer than ``l`` shingles that some other set's prefix holds too can link with nothing and
   go. Bitmaps of fixed size spare most rows of these joins their shuffle.
3. The rest is ordered from rare to frequent shingles, by counts over all of it. Each set
   chooses its own ``l`` where the estimated cost, probes and candidates to verify, is least.
   A pair is a candidate if it shares the smaller of both ``l`` within the bounds of its sizes.
4. First each set meets one set of each posting list, the one whose shingles are the most
   frequent on average. Verified links give components; lists of one component are done with. In
   the others, all sets meet another one, chosen by chance, as long as that links something.
   Then only sets of different components meet, those outside a list's largest component with
   all others, so no link between components is lost, while a group of n near copies costs
   about n verifications. Pairs whose sketches differ in more places than the threshold allows
   aren't compared: each such place stands for a shingle that only one of both sets has.

Verification is exact on whole sets of 64-bit hashes of shingles. Null and empty texts have no shingles and link with
nothing, nor does a row with a null id, whose component is null. Repeated rows and ids stay;
an empty table gives an empty result; the other columns of docs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bitmap, bounded_memory, cut, in_bitmap, many_small_plans, table
from tessera.llm.components import components
from tessera.llm.shingles import shingle_sets

#: l of the first prefix, in percent of the set's size.
EXTRA = 8
#: Choices of l, and the cost of comparing one shingle of a candidate in probes.
MOST_MATCHES = 8
#: Words of 64 bits of a parity sketch.
SKETCH = 8
BITS = [f"bits{i}" for i in range(SKETCH)]
VERIFY_COST = 0.05
#: Rounds of stars at most, before all sets of what is left in a list meet.
MOST_STARS = 6


def overlap_floor(n, percent: int):
    """The least overlap of a set of n with any set that it links with: ceil(percent n / 100)."""
    return -(-percent * n // 100)


def first_prefix(n: int, percent: int) -> tuple[int, int]:
    """(length, shingles that must be shared) of a set's prefix by hash order."""
    p = n - overlap_floor(n, percent) + 1
    length = min(n, p + max(1, -(-n * EXTRA // 100)) - 1)
    return length, length - p + 1


def _node(doc_id: int | None, s: np.ndarray) -> tuple[bytes | None, int | None]:
    """A set's digest of 128 bits and the first 64 of them; none for an empty set or a null id."""
    if doc_id is None or not len(s):
        return None, None
    node = xxhash.xxh3_128_digest(s.tobytes())
    return node, int.from_bytes(node[:8], "big", signed=True)


def _prefixes(size: int, percent: int):
    """(key, h) of every shingle in each set's first prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, heads = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size)):
                _, key = _node(doc_id, s)
                if key is not None:
                    heads.append(s[: first_prefix(len(s), percent)[0]])
                    keys.append(np.full(len(heads[-1]), key, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(heads).view(np.int64))], ["key", "h"])

    return run


def _signatures(size: int, percent: int, shared: Broadcast):
    """Each row's set: its size, digest, the shingles needed of its first prefix and those of them that the bitmap knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids, n, nodes, needs, heads = [], [], [], [], []
            for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size)):
                node, _ = _node(doc_id, s)
                length, need = first_prefix(len(s), percent) if node else (0, 0)
                head = s[:length]
                head = head[in_bitmap(held, head)]
                ids.append(doc_id)
                n.append(len(s))
                nodes.append(node)
                needs.append(need)
                heads.append(head.view(np.int64) if len(head) >= max(need, 1) else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(needs, pa.int32()), pa.array(heads, pa.list_(pa.int64()))],
                ["doc_id", "n", "node", "need", "head"],
            )

    return run


def _chosen(ids: Broadcast):
    """Rows (doc_id, hashed id, text) whose hashed id the bitmap knows, as (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(ids.value, np.uint8)
        for batch in batches:
            known = in_bitmap(held, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.select([0, 2]).filter(pa.array(known))

    return run


def parity_sketch(s: np.ndarray) -> list[int]:
    """SKETCH words whose bits tell whether an odd number of the set's shingles fall on them."""
    odd = np.bincount(((s >> np.uint64(20)) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _sets(size: int):
    """Rows (digest, low, text) as (digest, low, n, shingles, sketch), without those whose text has another set than the digest's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2), size))
            held = [(node, low, s) for node, low, s in named if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == node]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([node for node, *_ in held], pa.binary()),
                    pa.array([low for _, low, _ in held], pa.int64()),
                    pa.array([len(s) for *_, s in held], pa.int64()),
                    pa.array([s.view(np.int64) for *_, s in held], pa.list_(pa.int64())),
                    pa.array([parity_sketch(s) for *_, s in held], pa.list_(pa.int64())),
                ],
                ["digest", "low", "n", "shingles", "sketch"],
            )

    return run


def _survivors(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """(node, low) of the classes whose hash-order prefix holds enough shingles that other sets' prefixes hold too."""
    heads = classes.where("head is not null").select("node", "low", "need", F.explode("head").alias("h")).join(shared, "h")
    return heads.groupBy("node", "low").agg(F.count(F.lit(1)).alias("hits"), F.max("need").alias("need")).where("hits >= need").select("node", "low")


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """(h, node, n, alone, pos, l, central, bits): the shingles in each set's adaptive prefix, without those of one set only, each with the set's sketch.

    Positions count from the rarest shingle; the ``alone`` shingles of one set only come first and
    match nothing. A set with too many of them can link with nothing and has no posting.
    """
    each = sets.select("node", F.explode("shingles").alias("h"))
    known = each.groupBy("h").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1")
    found = each.join(known, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("found"))
    bits = [F.col("sketch")[i].alias(b) for i, b in enumerate(BITS)]
    ranked = found.join(sets.select("node", "n", *bits), "node")
    floor = F.ceil(F.col("n") * percent / F.lit(100))
    floor = F.when((floor - 1) * 100 >= F.col("n") * percent, floor - 1).otherwise(floor).cast("int")
    ranked = ranked.withColumn("alone", (F.col("n") - F.size("found")).cast("int")).withColumn("p", (F.col("n") - floor + 1).cast("int")).withColumn("floor", floor)

    ranked = ranked.where("alone < p")

    def probes(ell: Column) -> Column:
        held = F.slice("found", F.lit(1), F.greatest(F.col("p") + ell - 1 - F.col("alone"), F.lit(0)))
        return F.aggregate(held, F.lit(0.0), lambda acc, x: acc + x["df"] - 1)

    choices = F.transform(F.sequence(F.lit(1), F.least(F.lit(MOST_MATCHES), F.col("floor"))), lambda ell: F.struct((probes(ell) * (1 + VERIFY_COST * F.col("n") / ell)).alias("cost"), ell.alias("l")))
    chosen = ranked.withColumn("l", F.array_min(choices)["l"]).withColumn("central", F.aggregate("found", F.lit(0.0), lambda acc, x: acc + F.log2(x["df"].cast("double"))) / F.col("n"))
    held = F.slice("found", F.lit(1), F.greatest(F.col("p") + F.col("l") - 1 - F.col("alone"), F.lit(0)))
    return chosen.select("node", "n", "alone", "l", "central", *BITS, F.posexplode(held).alias("at", "x")).select(F.col("x.h").alias("h"), "node", "n", "alone", (F.col("alone") + F.col("at")).alias("pos"), "l", "central", *BITS)


def _near_enough(percent: int) -> Column:
    """Whether a shared shingle counts for the pair of postings (node, n, alone, pos, l) and (node2, n2, …).

    With o the overlap that the pair needs, either set has room for n - o shingles that don't match.
    """
    least = F.expr(f"(({percent} * (n + n2) + {99 + percent}) div {100 + percent})")
    room, room2 = F.col("n") - least, F.col("n2") - least
    ell = F.least("l", "l2")
    small, large = F.least("n", "n2"), F.greatest("n", "n2")
    fits = (F.col("alone") <= room) & (F.col("alone2") <= room2) & (100 * small >= percent * large)
    return fits & (F.col("pos") < room + ell) & (F.col("pos2") < room2 + ell)


def _candidates(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of rows (node, l, node2, l2), one for each shared shingle, with enough of them."""
    pair = rows.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"), F.least("l", "l2").alias("l"))
    return pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits"), F.max("l").alias("l")).where("hits >= l").select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose exact similarity reaches the threshold."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - both
    return pairs.join(side("a"), "a").join(side("b"), "b").where(100 * both >= percent * either).select("a", "b")


def _components(postings: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, label) of all sets that link with another: the components that all links would give."""
    held = ["node", "n", "alone", "pos", "l", "label", *BITS]
    lists = postings.withColumn("label", F.col("node"))
    differing = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}2"))) for b in BITS), F.lit(0))
    most = F.col("n") + F.col("n2") - 2 * F.expr(f"(({percent} * (n + n2) + {99 + percent}) div {100 + percent})")
    fits = (F.col("label") != F.col("label2")) & _near_enough(percent) & (differing <= most)
    labels = None

    def joined(links: DataFrame) -> DataFrame:
        """Labels after further links: a label links its component's nodes as well as what gave it did."""
        return components(links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))

    for turn in range(MOST_STARS):
        # First the set whose shingles are the most frequent ones on average, then any by chance.
        order = -F.col("central") if turn == 0 else F.xxhash64("node", F.lit(turn))
        # Lists of one component have no pivot.
        pivots = lists.groupBy("h").agg(F.min_by(F.struct(*held), F.struct(order, "node")).alias("q"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("h", "q")
        starred = lists.join(pivots, "h").select(*held, *[F.col(f"q.{c}").alias(f"{c}2") for c in held]).where(fits)
        found = cut(_verified(_candidates(starred), sets, percent))
        if turn and found.isEmpty():
            break
        labels = joined(found)
        lists = lists.join(labels.withColumnRenamed("label", "joined"), "node", "left").withColumn("label", F.coalesce("joined", "label")).drop("joined")
        several = lists.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("h")
        lists = cut(lists.join(several, "h", "left_semi"))
    sizes = lists.groupBy("h", "label").agg(F.count(F.lit(1)).alias("c"))
    top = sizes.groupBy("h").agg(F.max(F.struct("c", "label"))["label"].alias("top"))
    lists = lists.join(top, "h")
    outside = lists.where("label <> top")
    inside = lists.select("h", *[F.col(c).alias(f"{c}2") for c in held])
    crossed = outside.join(inside, "h").where(((F.col("label2") == F.col("top")) | (F.col("node") < F.col("node2"))) & fits)
    last = cut(_verified(_candidates(crossed), sets, percent))
    return labels if last.isEmpty() else joined(last)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id long, text string): doc_id, n_shingles long, component_id long.

    component_id is the smallest doc_id that a row reaches by links, its own included.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sc = docs.sparkSession.sparkContext
    with bounded_memory(docs.sparkSession):
        prefixes = texts.mapInArrow(_prefixes(size, percent), "key long, h long")
        shared = cut(prefixes.groupBy("h").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("h"))
        held = sc.broadcast(bitmap(shared, "h"))
        base = cut(texts.mapInArrow(_signatures(size, percent, held), "doc_id long, n long, node binary, need int, head array<long>"))
        held.destroy()
        classes = base.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.max("need").alias("need"), F.first("head").alias("head"))
        kept = cut(_survivors(classes, shared).withColumn("hashed", F.xxhash64("low")))

        held = sc.broadcast(bitmap(kept, "hashed"))
        chosen = texts.select("doc_id", F.xxhash64("doc_id").alias("hashed"), "text").mapInArrow(_chosen(held), "doc_id long, text string")
        sets = chosen.join(kept, F.col("doc_id") == F.col("low")).select("node", "low", "text").mapInArrow(_sets(size), "digest binary, low long, n long, shingles array<long>, sketch array<long>")
        # Short ids stand for digests while shingles are shuffled; the checkpoint fixes them.
        named = cut(sets.withColumn("node", F.monotonically_increasing_id()))
        held.destroy()
        named_sets = named.select("node", "n", "shingles", "sketch")
        postings = cut(_postings(named_sets, percent))
        with many_small_plans(docs.sparkSession):
            labels = _components(postings, named_sets, percent)
            labelled = labels.join(named.select("node", "digest", "low"), "node")
            smallest = labelled.groupBy("label").agg(F.min("low").alias("component"))
            # A plan of its own: the driver holds plans, their generated code and their metrics, and one of everything is far larger than its parts.
            linked = cut(labelled.join(smallest, "label").groupBy(F.col("digest").alias("node")).agg(F.min("component").alias("component")))

    several = classes.select("node", "low", "copies").join(linked, "node", "left").where("copies > 1 or component is not null").select("node", F.coalesce("component", "low").alias("component"))
    return base.select("doc_id", "n", "node").join(several, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by 3-word shingles at 90 of 100: doc_id, n_shingles, component_id."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=90)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                 ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT s, count(*) AS c FROM s GROUP BY s),
o AS (  -- any linked pair shares one of the rarest n - ceil(0.9 n) + 1 shingles of either side
  SELECT s.doc_id, s.s, row_number() OVER (PARTITION BY s.doc_id ORDER BY c, s.s) AS i, n
  FROM s JOIN f ON s.s = f.s JOIN n ON n.doc_id = s.doc_id),
c AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM o a JOIN o b ON a.s = b.s AND a.doc_id < b.doc_id
  WHERE a.i <= a.n - ceil(a.n * 90 / 100.0) + 1 AND b.i <= b.n - ceil(b.n * 90 / 100.0) + 1),
p AS (SELECT c.a, c.b, count(*) AS k FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.s = x.s GROUP BY c.a, c.b),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS at FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.at)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.at) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""
