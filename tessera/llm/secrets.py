"""Secret scans in DataFrame expressions only.

Base patterns find assignments, access keys and long hexadecimal runs. Beyond them, every
long run of key characters is a candidate for two character Markov models, one of random
strings and one of ordinary identifiers: a candidate whose log-likelihood ratio passes a
threshold is a secret of kind ``markov``, unless it meets a base span. Of other candidates, the
segments between ``/``, ``_``, ``=`` and ``-`` are weighed in the same way, so that ordinary words
beside a key don't hide it; segments of digits alone are numbers rather than keys.

Both models are first-order with add-one smoothing over one alphabet: one learns from generated
keys in three spellings, the other from the identifiers of one to three words of all documents.
The threshold is what at most one of a thousand of these identifiers of a candidate's length
reaches, and at least 0.

Null and empty texts have no spans; the digest is then that of the empty string. Ids may be
null or repeat; an empty table gives an empty result and models of smoothing alone. Columns
``base`` and ``spans`` of docs are replaced, all others stay. The work on a text grows with its
length, whatever it holds: arrays are handled in blocks.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import free_name, table

#: The base patterns and the least length of what they keep.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8
#: Runs of key characters that the models look at.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Parts of a run that are weighed on their own; 12 characters set keys and words apart.
SEGMENT = r"[A-Za-z0-9+]{12,}"
#: Words of identifiers: letters that aren't part of a longer run of key characters.
WHOLE_WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,16}(?![A-Za-z0-9+/_=-])"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Items of an array, and characters of a text, that are handled at a time.
BLOCK, PIECE = 256, 4096


def bound(x: Column, body) -> Column:
    """body(x) with x evaluated once, however often body refers to it."""
    return F.element_at(F.transform(F.array(x), body), 1)


def running(items: Column, start: Column, step, kind: str) -> Column:
    """An array of what step(state, item) = (next state, emitted) emits, of type array<kind>.

    Arrays are copied when they grow, so what is emitted is gathered block by block.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        state, emitted = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(emitted)).alias("out"))

    def block(held: Column, acc: Column) -> Column:
        joined = lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out"))
        return F.aggregate(held, F.struct(acc["state"].alias("state"), none.alias("out")), one, joined)

    def whole(held: Column) -> Column:
        blocks = F.sequence(F.lit(1), F.size(held), F.lit(BLOCK))
        first = F.struct(start.alias("state"), none.alias("out"))
        out = F.aggregate(blocks, first, lambda acc, i: block(F.slice(held, i, F.lit(BLOCK)), acc), lambda acc: acc["out"])
        return F.when(F.size(held) > 0, out).otherwise(none)

    return bound(items, whole)


def matches(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans (start, kind, end) of a pattern's leftmost matches, in code points, and of those only what keep(match) accepts.

    The pieces between matches and the matches in turn give each offset. No match is empty.
    """
    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + x["gap"]
        end = begin + x["size"]
        return end, F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["kept"].alias("kept"))

    def pairs(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        one = lambda x: F.struct(F.length(x["piece"]).alias("gap"), F.length(x["match"]).alias("size"), (F.lit(True) if keep is None else keep(x["match"])).alias("kept"))
        zipped = F.transform(F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), found.alias("match")), one)
        return F.when(F.size(found) > 0, zipped).otherwise(F.array())

    spans = running(bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pairs), F.lit(0), step, "struct<start:int,kind:int,end:int,kept:boolean>")
    return F.transform(F.filter(spans, lambda x: x["kept"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))).cast(SPAN)


@dataclass
class KeyModel:
    """Log-likelihood ratios of all pairs of characters, row by row, and the threshold for a sum."""

    ratios: list[float]
    threshold: float

    def ratio(self, s: Column) -> Column:
        """The log-likelihood ratio of a string: above 0, it is rather random."""
        line = F.from_json(F.lit(json.dumps(self.ratios)), "array<double>")
        places = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c))

        def step(acc: Column, b: Column) -> Column:
            more = F.when(acc["a"] >= 0, F.element_at(line, acc["a"] * (len(ALPHABET) + 1) + b + 1)).otherwise(0.0)
            return F.struct(b.alias("a"), (acc["sum"] + more).alias("sum"))

        return F.aggregate(places, F.struct(F.lit(-1).alias("a"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])


def random_keys(spark: SparkSession, rows: int) -> DataFrame:
    """(s): generated keys in three spellings."""
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    letters = F.base64(F.unhex(digest))
    style = F.when(F.col("id") % 3 == 0, letters).when(F.col("id") % 3 == 1, digest).otherwise(F.upper(F.regexp_replace(letters, "[+/=]", "")))
    return spark.range(rows).select(style.alias("s"))


def words(docs: DataFrame) -> DataFrame:
    """(w): the words of each text, in order."""
    return docs.select(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WHOLE_WORD), F.lit(0)).alias("w")).where(F.size("w") > 0)


def identifiers(docs: DataFrame, least: int = 1) -> DataFrame:
    """(s): the identifiers of a text, which are its words one by one, by twos and by threes, joined by ``_``, of ``least`` characters or more."""
    def joined(n: int) -> Column:
        at = lambda i: F.concat_ws("_", *[F.element_at("w", i + k) for k in range(n)])
        return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1, F.lit(n)), at)).otherwise(F.array().cast("array<string>"))

    names = F.concat(*[F.filter(joined(n), lambda x: F.length(x) >= least) for n in (1, 2, 3) if 16 * n + n - 1 >= least])
    return words(docs).select(F.explode(names).alias("s"))


def identifier_pairs(docs: DataFrame) -> DataFrame:
    """(a, b, n): how often a character follows another in all identifiers of all documents.

    Each different word is taken apart once, with the times that identifiers hold it, and that they have it before or behind ``_``.
    """
    i, m = F.col("i"), F.col("m")
    within = lambda n: i < m - m % n
    times = lambda *tests: sum((t.cast("long") for t in tests), F.lit(0))
    each = words(docs).select(F.size("w").alias("m"), F.posexplode("w").alias("i", "s")).select(
        "s",
        (times(within(2), within(3)) + 1).alias("inside"),
        times(within(2) & (i % 2 == 1), within(3) & (i % 3 > 0)).alias("behind"),
        times(within(2) & (i % 2 == 0), within(3) & (i % 3 < 2)).alias("before"),
    )
    known = each.groupBy("s").agg(*[F.sum(c).alias(c) for c in ("inside", "behind", "before")])
    marked = known.select(F.concat(F.lit("_"), "s", F.lit("_")).alias("s"), "inside", "behind", "before", F.explode(F.sequence(F.lit(1), F.length("s") + 1)).alias("at"))
    n = F.when(F.col("at") == 1, F.col("behind")).when(F.col("at") == F.length("s") - 1, F.col("before")).otherwise(F.col("inside"))
    return pairs(marked, n)


def pairs(rows: DataFrame, n: Column) -> DataFrame:
    """(a, b, n): places in ALPHABET of the characters at ``at`` of ``s`` and behind it, n times each."""
    place = lambda at: F.instr(F.lit(ALPHABET), F.substring("s", at, F.lit(1)))
    return rows.groupBy(place(F.col("at")).alias("a"), place(F.col("at") + 1).alias("b")).agg(F.sum(n).alias("n"))


def train(docs: DataFrame, random_rows: int = 20_000) -> KeyModel:
    """Count pairs of characters by class, over all documents; at most 68 * 68 counts a class reach the driver."""
    keys = random_keys(docs.sparkSession, random_rows).select("s", F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("at"))
    size = len(ALPHABET) + 1
    counts = [[[1.0] * size for _ in range(size)] for _ in range(2)]
    for kind, found in ((0, identifier_pairs(docs)), (1, pairs(keys, F.lit(1)))):
        for r in found.collect():
            counts[kind][r["a"]][r["b"]] += r["n"]
    chance = [[[math.log(x / sum(row)) for x in row] for row in table] for table in counts]
    model = KeyModel([round(chance[1][a][b] - chance[0][a][b], 6) for a in range(size) for b in range(size)], 0.0)
    reached = identifiers(docs, 20).select(model.ratio(F.col("s")).alias("r")).agg(F.percentile_approx("r", 0.999, 10_000).alias("r")).first()["r"]
    model.threshold = max(0.0, reached or 0.0)
    return model


def scan(docs: DataFrame, model: KeyModel) -> DataFrame:
    """docs with ``base`` and ``spans``: arrays of (start, kind, end), by start and then kind as listed in KINDS."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Columns of their own, which the optimizer doesn't fold into what refers to them.
    name, name_blocks = free_name(docs, "scanned"), free_name(docs, "scanned_blocks")
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE
    base = F.array_sort(F.concat(matches(text, ASSIGN, 0, value), matches(text, ACCESS, 1), matches(text, HEX, 2)))
    is_key = lambda m: model.ratio(m) > model.threshold
    # Base spans by blocks, so that a span is held only against those that it may meet.
    block = lambda i: F.slice(name, i, F.lit(BLOCK))
    blocks = F.when(
        F.size(name) > 0,
        F.transform(F.sequence(F.lit(1), F.size(name), F.lit(BLOCK)), lambda i: F.struct(F.array_min(F.transform(block(i), lambda y: y["start"])).alias("low"), F.array_max(F.transform(block(i), lambda y: y["end"])).alias("high"), block(i).alias("held"))),
    ).otherwise(F.array())
    meets = lambda x: F.exists(name_blocks, lambda z: (x["start"] < z["high"]) & (z["low"] < x["end"]) & F.exists(z["held"], lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))

    def keys(x: Column) -> Column:
        parts = F.when(x["key"], F.array()).otherwise(matches(x["run"], SEGMENT, 3, lambda m: m.rlike("[A-Za-z]") & is_key(m)))
        moved = F.transform(parts, lambda y: F.struct((x["start"] + y["start"]).alias("start"), y["kind"].alias("kind"), (x["start"] + y["end"]).alias("end")))
        whole = F.array(F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
        return F.when(x["key"], whole).otherwise(moved)

    runs = F.arrays_zip(matches(text, CANDIDATE, 3).alias("at"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("run"))
    weighed = F.transform(runs, lambda x: F.struct(x["at"]["start"].alias("start"), x["at"]["kind"].alias("kind"), x["at"]["end"].alias("end"), x["run"].alias("run"), (is_key(x["run"]) & ~meets(x["at"])).alias("key")))
    held = [c for c in docs.columns if c not in ("base", "spans")]
    found = docs.select(*held, base.alias(name)).withColumn(name_blocks, blocks)
    more = F.flatten(F.transform(weighed, keys))
    spans = F.array_sort(F.concat(name, F.filter(more, lambda x: ~meets(x))))
    return found.select(*held, F.col(name).alias("base"), spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def redact(scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Replace all spans in ``text`` by a mark, overlapping ones as one; a text without spans stays as it is."""
    cut_up = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        return F.greatest(at, x["end"]), F.struct(at.alias("low"), F.when(x["start"] >= at, x["start"]).otherwise(-1).alias("high"))

    def whole(pieces: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first = F.floor(a / PIECE).cast("int")
            held = F.array_join(F.slice(pieces, first + 1, F.ceil(b / PIECE).cast("int") - first), "")
            return F.when(b > a, F.substring(held, a - first * PIECE + 1, b - a)).otherwise("")

        gaps = F.filter(running(F.col("spans"), F.lit(0), step, "struct<low:int,high:int>"), lambda g: g["high"] >= 0)
        before = F.transform(gaps, lambda g: F.concat(between(g["low"], g["high"]), F.lit(mark)))
        return F.concat(F.array_join(before, ""), between(F.array_max(F.transform("spans", lambda x: x["end"])), F.length("text")))

    return scanned.withColumn("text", F.when(F.size("spans") > 0, bound(cut_up, whole)).otherwise(F.col("text")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs))
    count = lambda spans, kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return found.select("doc_id", *[count("base", k) for k in range(3)], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count("spans", 3))
