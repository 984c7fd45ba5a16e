"""Text functions as Column builders; nothing here leaves the JVM but the recursive splitter."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that are one of a to z with marks, by their canonical decomposition, and those letters.
_MARKED = [(c, d[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()]
MARKED, BARE = ("".join(x) for x in zip(*_MARKED))
#: White space as JavaScript's \\s and trim() know it.
SPACE = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def trim(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, rf"^{SPACE}+|(?<!{SPACE}){SPACE}+\z", "")


def bare(x: Column) -> Column:
    """Lower case without accents, composed or combining; only texts that aren't ASCII are looked at for them, letter by letter."""
    plain = F.regexp_replace(F.translate(x, MARKED, BARE), r"[\x{300}-\x{36f}]+", "")
    return F.lower(F.when(F.length(x) < F.octet_length(x), plain).otherwise(x))


def fold(x: Column) -> Column:
    """Lower case without accents, composed or combining, trimmed."""
    return trim(bare(x))


def squeeze(x: Column) -> Column:
    """fold, and white space of any length as one space."""
    return F.trim(F.regexp_replace(fold(x), rf"{SPACE}+", " "))


def slug(x: Column, mark: str = "-", most: int | None = None) -> Column:
    """fold with every run of other characters as one mark, none at either end, cut to ``most``."""
    # White space at the ends is part of the runs there.
    out = F.regexp_replace(F.regexp_replace(bare(x), "[^a-z0-9]+", mark), f"^{mark}|{mark}$", "")
    return out if most is None else F.substring(out, 1, most)


def digits_only(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def jid(x: Column) -> Column:
    """struct(external_id, phone) of a messenger id: what precedes @, and its digits."""
    name = F.substring_index(F.trim(x), "@", 1)
    return F.struct(name.alias("external_id"), digits_only(name).alias("phone"))


def first_integer(x: Column) -> Column:
    """The first run of digits as a long; null where there is none or it is too long for one."""
    return F.nullif(F.regexp_extract(x, r"(\d+)", 1), F.lit("")).try_cast("long")


def city_and_state(x: Column) -> Column:
    """struct(cidade, uf) of 'City, UF' or 'City / UF'; uf is '' where there is none."""
    pattern = r"^\s*(.+?)\s*[,/]\s*([A-Za-z]{2})\s*$"
    city = F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))
    return F.struct(F.coalesce(city, F.trim(x)).alias("cidade"), F.upper(F.regexp_extract(x, pattern, 2)).alias("uf"))


def money(x: Column) -> Column:
    """'R$ 1.234,56' as a double; 0 where there is no number."""
    found = F.regexp_extract(x, r"([0-9][0-9.]*(?:,[0-9]+)?)", 1)
    plain = F.replace(F.replace(found, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.coalesce(F.nullif(plain, F.lit("")).cast("double"), F.lit(0.0))


def brl(x: Column) -> Column:
    """A number as pt-BR money, 'R$ 1.234,56' with a space that doesn't break; null stays null."""
    plain = F.translate(F.format_number(F.abs(x), 2), ",.", ".,")
    return F.when(x.isNotNull() & ~F.isnan(x), F.concat(F.when(F.round(x, 2) < 0, "-").otherwise(""), F.lit("R$\u00a0"), plain))


def is_url(x: Column) -> Column:
    return F.coalesce(F.trim(x).rlike("(?i)^https?://"), F.lit(False))


def millis(x: Column) -> Column:
    """Milliseconds since 1970 as a timestamp."""
    return F.timestamp_millis(x.cast("long"))


def credits_price(x: Column) -> Column:
    return F.round(x * 4.95, 2)


def opening_hours(x: Column) -> Column:
    """What follows 'Horário:' up to the next bar, else null."""
    return F.nullif(F.trim(F.regexp_extract(x, r"(?i)Horário:\s*([^|]+)", 1)), F.lit(""))


def ellipsis(x: Column, most: int = 280) -> Column:
    """Texts above ``most`` cut to three characters less, trimmed, with an ellipsis."""
    return F.when(F.length(x) > most, F.concat(F.trim(F.substring(x, 1, most - 3)), F.lit("…"))).otherwise(x)


def preview(text: Column, kind: Column, most: int = 200) -> Column:
    return F.substring(F.coalesce(F.nullif(text, F.lit("")), F.concat(F.lit("["), kind, F.lit("]"))), 1, most)


def is_uuid(x: Column) -> Column:
    return x.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def clean_score(x: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(x, F.lit(0))))


def none_if_blank(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def _meta_value(meta: Column, key: str) -> Column:
    return F.try_variant_get(F.try_parse_json(meta), f"$.{key}", "variant")


def meta_text(meta: Column, key: str) -> Column:
    """A key's text in JSON metadata, trimmed; null where it is blank, missing or no text."""
    value = _meta_value(meta, key)
    return F.when(F.schema_of_variant(value) == "STRING", none_if_blank(trim(F.try_variant_get(value, "$", "string"))))


def meta_number(meta: Column, key: str) -> Column:
    """A key's number in JSON metadata, or its text where that is a number; null where it is neither or not finite."""
    value = _meta_value(meta, key)
    number = F.when(F.schema_of_variant(value) != "BOOLEAN", trim(F.try_variant_get(value, "$", "string"))).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def month_grid(day: Column) -> Column:
    """struct(first_weekday, days) of a date's month: how many cells a calendar that starts on Sunday leaves empty before it, and its days."""
    first = F.trunc(day, "month")
    return F.struct((F.dayofweek(first) - 1).alias("first_weekday"), F.dayofmonth(F.last_day(first)).alias("days"))


def content_hash(*parts: Column) -> Column:
    """sha256 of the parts joined by bars; null parts are skipped."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def short_id(prefix: str, digest: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(digest, 1, 16))


def escape_xml(x: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(char), F.lit(name))
    return x


def strip_markdown(x: Column) -> Column:
    """Links as their labels; emphasis, headings, list marks, straight quotes and backticks removed."""
    for pattern, into in ((r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"(?<!\*)\*([^*\n]+)\*(?!\*)", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^[*-]\s+", ""), (r"[\"'`]", ""), (r"\n{3,}", "\n\n")):
        x = F.regexp_replace(x, pattern, into)
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def clean_pdf_text(x: Column) -> Column:
    """Words broken at line ends joined, soft hyphens and leaders of four or more dots, ellipses or underscores removed, white space of any length as one space."""
    for pattern, into in ((rf"(\p{{L}})-{SPACE}*\n{SPACE}*(\p{{L}})", "$1$2"), (r"\x{ad}", ""), (r"[.\x{2026}_]{4,}", " "), (rf"{SPACE}+", " ")):
        x = F.regexp_replace(x, pattern, into)
    return F.trim(x)


def fixed_slices(x: Column, size: int = 1200) -> Column:
    """Consecutive slices of ``size`` characters; none of an empty text."""
    count = F.ceil(F.length(x) / F.lit(size)).cast("int")
    each = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(x, i * size + 1, F.lit(size)))
    return F.when(F.length(x) > 0, each).otherwise(F.array().cast("array<string>"))


#: Bytes of text that the recursive splitter takes at a time.
GROUP_BYTES = 1 << 20
#: Where a text is cut, the coarsest first; without any of these it is cut anywhere.
MARKS = ("\n\n", "\n", ". ", " ")


def _windows(parts: list[str], mark: str, size: int, overlap: int) -> list[str]:
    """Runs of parts, joined by their mark, of at most ``size`` characters where a part isn't longer itself.

    A run starts again with the last parts of the one before it, as many as are together no
    longer than ``overlap`` and leave room for the next part. Blank runs go.
    """
    before = [0]
    for p in parts:
        before.append(before[-1] + len(p))
    length = lambda i, j: before[j] - before[i] + max(0, j - i - 1) * len(mark)
    out, start = [], 0
    for end, part in enumerate(parts):
        room = lambda i: size - len(part) - (len(mark) if end > i else 0)  # noqa: B023, E731
        if start < end and length(start, end) > room(start):
            out.append(mark.join(parts[start:end]))
            while length(start, end) > min(overlap, max(0, room(start))):
                start += 1
    out.append(mark.join(parts[start:]))
    return [x for x in map(str.strip, out) if x]


def _pieces(text: str, size: int, marks: tuple[str, ...]) -> list[str]:
    """Pieces of at most ``size`` characters. Parts between the coarsest mark that the text has are put together again with that mark; one that is too long is cut at finer marks."""
    mark = next((m for m in marks if m in text), None)
    if mark is None:
        return [x for i in range(0, len(text), size) if (x := text[i : i + size].strip())]
    finer = marks[marks.index(mark) + 1 :]
    out: list[str] = []
    short: list[str] = []
    for part in text.split(mark):
        if len(part) < size:
            short.append(part)
        else:
            out += _windows(short, mark, size, 0) + _pieces(part, size, finer)
            short = []
    return out + _windows(short, mark, size, 0)


def split_recursively(text: str | None, size: int = 1000, overlap: int = 120, least: int = 20) -> list[str]:
    """Chunks of at most ``size`` characters: pieces put together by spaces, each chunk beginning with the last pieces of the one before, up to ``overlap``; chunks under ``least`` go."""
    pieces = _pieces((text or "").strip(), size, MARKS)
    return [c for c in _windows(pieces, " ", size, min(overlap, max(0, size - 1))) if len(c) >= least]


def chunked(size: int = 1000, overlap: int = 120, least: int = 20):
    """Batches of texts to lists of their chunks. Only about GROUP_BYTES of text at a time, a text at least, are Python strings, so memory hangs on neither the rows nor the texts of a batch."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(texts):
                end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + GROUP_BYTES, side="right")))
                yield pa.array([split_recursively(t, size, overlap, least) for t in texts.slice(start, end - start).to_pylist()], pa.list_(pa.string()))
                start = end

    return run


def recursive_chunks(x: Column, size: int = 1000, overlap: int = 120, least: int = 20) -> Column:
    """array<string> of split_recursively."""
    return F.arrow_udf(chunked(size, overlap, least), "array<string>")(x)


def term_hits(terms: list[str], text: Column) -> Column:
    """How many folded terms of three or more letters the lower-case text has. The text keeps its accents; accented words then never match a folded term."""
    found = [F.contains(F.lower(text), fold(F.lit(t))).cast("int") for t in terms if len(t) > 2]
    return sum(found, F.lit(0))
