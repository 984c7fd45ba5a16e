"""Text of raw pages, and the activities that it offers.

One automaton looks for all patterns in one pass over a text: the phrase that ends an offer, the
words of the fallback and those before a description. An offer is a name, a description in
parentheses if there is one, the phrase and a plan, each on lines of its own; the name is the whole
run of letters, spaces and hyphens before the line break, from where the last offer ended. Every
run of letters is looked at once, so hostile pages take time in proportion to their length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.classify import canonical_activity

# The phrase, the letters of names, the words that count where a page states no offer, with their plan, and those before a description.
PHRASE = "disponível a partir do plano"
LETTERS = "a-záéíóúâêîôûãõç"
KEYWORDS = ["Musculação", "Funcional", "Crossfit", "Jiu Jitsu", "Muay Thai", "Boxe", "Capoeira", "Pilates", "Yoga", "Natação", "Dança", "Fisioterapia", "Spa", "Massagem", "Tênis", "Lutas"]
KEYWORD_PLAN = "TP 1"
INTRODUCTIONS = ["descrição", "sobre", "apresenta"]
_BLANK = r"\s﻿"
_LOWER = {ord(c.upper()): c for c in "abcdefghijklmnopqrstuvwxyzáéíóúâêîôûãõç"}
_RUN, _LETTER = re.compile(rf"[{LETTERS}{_BLANK}-]+"), re.compile(rf"[{LETTERS}]")
_PLAN = re.compile(rf"[{_BLANK}]+(tp[{_BLANK}]*[a-z0-9_]+)")
OFFER = "struct<nome:string,plano_minimo:string,descricao_extra:string>"
FOUND = f"struct<offers:array<{OFFER}>,keywords:array<string>,descricao:string>"


@cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in (("phrase", [PHRASE]), ("keyword", KEYWORDS), ("introduction", INTRODUCTIONS)):
        for w in words:
            a.add_word(w.lower(), (kind, w, len(w)))
    a.make_automaton()
    return a


def _name_end(text: str, start: int, end: int) -> int | None:
    """Where a name that starts at start ends, if what follows up to end is white space with a line break last; names have two characters at least."""
    stripped = end - 1
    if end <= start or text[stripped] != "\n":
        return None
    while stripped > start + 2 and (text[stripped - 1].isspace() or text[stripped - 1] == "﻿"):
        stripped -= 1
    return stripped if stripped >= start + 2 else None


def offers_of(text: str, phrases: list[int]) -> list[tuple[str, str, str | None]]:
    """(name, plan, description) of each offer of a text in lower case of its own length; phrases: where the phrase stands."""
    plans = [(d, m) for d in phrases if (m := _PLAN.match(text, d + len(PHRASE)))]
    starts = [d for d, _ in plans]
    out, at = [], 0
    while starts and at <= starts[-1]:
        run = _RUN.search(text, at)
        if run is None:
            break
        at = run.end()
        letter = _LETTER.search(text, run.start(), run.end())
        if letter is None:
            continue
        start, found = letter.start(), None
        for k in range(bisect_left(starts, start), len(starts)):
            if starts[k] >= run.end():
                break
            end = _name_end(text, start, starts[k])
            if end is not None:
                found = (end, None, plans[k][1])
                break
        if found is None and text[run.end() : run.end() + 1] == "(":
            end, close = _name_end(text, start, run.end()), text.find(")", run.end())
            if end is not None and close > run.end() + 1:
                k = bisect_left(starts, close)
                gap = text[close + 1 : starts[k]] if k < len(starts) and starts[k] - close < 1 << 16 else "x"
                if gap.endswith("\n") and not gap.strip().strip("﻿"):
                    found = (end, (run.end() + 1, close), plans[k][1])
            elif close < 0:
                # No parenthesis closes any more, so only runs that hold the phrase count.
                text = text.replace("(", "[")
        if found is not None:
            end, extra, plan = found
            out.append(((start, end), plan.span(1), extra))
            at = plan.end()
    return out


def read_page(text: str | None) -> tuple[list, list[str], str]:
    """(offers, keywords, description) of one text."""
    text = text or ""
    lower = text.translate(_LOWER)
    phrases, keywords, first = [], set(), None
    for end, (kind, word, size) in _automaton().iter(lower):
        if kind == "phrase":
            phrases.append(end - size + 1)
        elif kind == "keyword":
            keywords.add(word)
        elif first is None or end - size + 1 < first[0]:
            first = (end - size + 1, end + 1)
    tidy = lambda span: text[slice(*span)].strip().strip("﻿").strip()
    offers = [(tidy(name), re.sub(rf"[{_BLANK}]+", " ", text[slice(*plan)]), None if extra is None else tidy(extra)) for name, plan, extra in offers_of(lower, phrases)]
    after = "" if first is None else text[first[1] : first[1] + 300]
    said = after.strip()[:200] + ("..." if len(after) > 200 else "")
    return offers, [w for w in KEYWORDS if w in keywords], said


def page_text(html: Column) -> Column:
    """Plain text of a page: without scripts, styles and comments, a line break for each other tag, common references decoded."""
    for pattern, into in ((r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "\n"), (r"(?s)<!--.*?-->", "\n"), (r"<[^>]*>", "\n"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        html = F.regexp_replace(html, pattern, into)
    return html


def with_activities(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages with ``modalidades``, an array of (nome, plano_minimo, descricao_extra), and ``descricao_curta``.

    Names are put into the closed vocabulary; of offers with one name the first stays. A page without
    an offer has the keywords that it holds, in their own order, with KEYWORD_PLAN. Null texts are empty.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [read_page(t) for t in texts]
            yield pd.DataFrame({"offers": [[{"nome": n, "plano_minimo": p, "descricao_extra": x} for n, p, x in o] for o, _, _ in rows], "keywords": [k for _, k, _ in rows], "descricao": [d for *_, d in rows]})

    read = F.pandas_udf(run, FOUND)(F.col(text))
    named = F.transform("_page.offers", lambda o: F.struct(canonical_activity(o["nome"]).alias("nome"), o["plano_minimo"].alias("plano_minimo"), o["descricao_extra"].alias("descricao_extra")))
    held = pages.withColumn("_page", read).withColumn("_named", named)
    first = F.filter("_named", lambda o, i: F.array_position(F.transform("_named", lambda x: x["nome"]), o["nome"]) == i + 1)
    words = F.transform("_page.keywords", lambda w: F.struct(w.alias("nome"), F.lit(KEYWORD_PLAN).alias("plano_minimo"), F.lit(None).cast("string").alias("descricao_extra")))
    out = held.withColumn("modalidades", F.when(F.size("_named") > 0, first).otherwise(words)).withColumn("descricao_curta", F.col("_page.descricao"))
    return out.drop("_page", "_named")
