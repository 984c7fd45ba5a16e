"""Activities, plans and places read from names, addresses, prices and questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.query_filters import ascii_words
from tessera.functions.text import first_integer

# Patterns on a name and its address, what they mean, and their weight in percent; the first that is found counts.
ACTIVITY_RULES = [
    (r"jiu[-\s]?jitsu|bjj|gracie", "jiu_jitsu", 95), (r"muay[-\s]?thai|thai[-\s]?boxe|thaitonns", "muay_thai", 95), (r"capoeira", "capoeira", 95), (r"pole\s*dance", "pole_dance", 95),
    (r"pilates", "pilates", 90), (r"yoga", "yoga", 90), (r"swim|nata[çc][aã]o|piscina", "natacao", 90),
    (r"dance\s*studio|dança|danca|corpo\s*de\s*baile|samba", "danca", 85), (r"<spa>", "spa", 85), (r"massoterapia|massagem", "massoterapia", 85),
    (r"fisioterap|fisi[oô]|reabilita[çc][aã]o|quiroprax|reab\s*clin", "fisioterapia", 85), (r"beach\s*tennis|<ptc>", "beach_tennis", 85),
    (r"dojo|dojô|artes\s*marciais|fight\s*center|moudak|boxe", "lutas", 80), (r"t[eê]nis", "tenis", 80), (r"funcional", "funcional", 80),
    (r"medita[çc][aã]o|mindfulness", "meditacao", 75), (r"est[eé]tica|dermatolog", "estetica", 75), (r"cl[ií]nica", "clinica", 70),
    (r"academia|<fit>|<gym>|smart\s*fit|target\s*fit|pro\s*\d+", "academia_geral", 50),
]
# Ranks of plans; other plans come last.
PLAN_RANKS = {"tp free": 0, "free": 0, "tp go": 1, "go": 1, "tp 1": 2, "tp 1+": 3, "tp 2": 4, "tp 3": 5, "tp 4": 6, "tp 5": 7, "tp 5+": 8, "tp 6": 9, "tp 7": 10}
UNKNOWN_RANK = 99


def _found(x: Column, pattern: str) -> Column:
    return F.coalesce(x.rlike("(?iu)" + ascii_words(pattern)), F.lit(False))


def classify_activity(name: Column, address: Column, price: Column) -> Column:
    """struct(modality, confidence, method): rules on the texts, then two kinds of studio, then the price.

    Null texts are empty and a null price says nothing; what nothing decides is
    'desconhecida', left to a model outside.
    """
    name = F.coalesce(name, F.lit(""))
    both = F.concat(name, F.lit(" "), F.coalesce(address, F.lit("")))
    steps = [(_found(both, pattern), label, weight / 100) for pattern, label, weight in ACTIVITY_RULES]
    steps += [(_found(name, "<studio>"), "pilates", 0.6), (_found(name, r"<espa[çc]o>") & _found(name, r"bem[\s-]?estar"), "pilates", 0.5)]
    steps += [(F.coalesce(price >= 500, F.lit(False)), "spa", 0.4), (F.coalesce((price > 0) & (price <= 80), F.lit(False)), "academia_geral", 0.4)]
    answer = lambda label, sure, how: F.struct(F.lit(label).alias("modality"), F.lit(sure).alias("confidence"), F.lit(how).alias("method"))
    out = answer("desconhecida", 0.0, "llm_fallback")
    for condition, label, sure in reversed(steps):
        out = F.when(condition, answer(label, sure, "rule")).otherwise(out)
    return out


def normal_plan(plan: Column) -> Column:
    """Lower case, without the product's name, white space squeezed; null is empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(plan, F.lit(""))), r"total\s*pass", ""), r"\s+", " "))


def plan_rank(plan: Column) -> Column:
    """A plan's known rank, else one more than the number it states, else 99; 'tp5' reads as 'tp 5'."""
    plain = normal_plan(plan)
    known = F.create_map(*[F.lit(x) for pair in PLAN_RANKS.items() for x in pair])
    stated = F.nullif(F.regexp_extract(plain, r"tp\s*(\d+)", 1), F.lit("")).try_cast("int") + 1
    return F.coalesce(F.try_element_at(known, F.regexp_replace(plain, r"^tp(?=\d)", "tp ")), stated, F.lit(UNKNOWN_RANK))


def asked_plan(question: Column) -> Column:
    """The plan that a question names, as 'TP 3+', 'TP GO' or 'TP Free', else null."""
    q = F.lower(question)
    number = F.nullif(F.regexp_extract(q, ascii_words(r"<tp\s*(\d+\+(?=[a-z0-9_])|\d+(?![a-z0-9_]))"), 1), F.lit(""))
    word = F.nullif(F.regexp_extract(q, ascii_words(r"<tp\s*(go|free)>"), 1), F.lit(""))
    return F.coalesce(F.concat(F.lit("TP "), number), F.when(word == "go", "TP GO").when(word == "free", "TP Free"))


def asked_credits(question: Column) -> Column:
    """The credits that a question names: 'ilimitado 70', else '70 créditos', else null."""
    q = F.lower(question)
    take = lambda pattern: F.nullif(F.regexp_extract(q, pattern, 1), F.lit("")).try_cast("int")
    return F.coalesce(take(r"ilimitado\s*(\d+)"), take(r"(\d+)\s*cr[eé]ditos?"))


def district_before(address: Column, city: str = "Fortaleza") -> Column:
    """What stands between the last comma and the city in an address, else null."""
    return F.nullif(F.trim(F.regexp_extract(address, rf"(?i),\s*([^,]+?)\s*(?:-|,)\s*{city}(?![A-Za-z0-9_])", 1)), F.lit(""))


#: Parts of activity names, the first that fits gives the label.
CANONICAL = [
    (("muay",), "Muay Thai"), (("jiu",), "Jiu Jitsu"), (("boxe", "boxing"), "Boxe"), (("capoeira",), "Capoeira"), (("pilates",), "Pilates"),
    (("yoga",), "Yoga"), (("nata", "swim"), "Natação"), (("funcional",), "Treinamento Funcional"), (("crossfit",), "Crossfit"),
    (("dança", "danca", "pole"), "Dança"), (("muscul",), "Musculação"), (("fisio",), "Fisioterapia"), (("spa",), "Spa"), (("massag",), "Massoterapia"), (("tênis", "tenis"), "Tênis"),
]


def canonical_activity(name: Column) -> Column:
    """An activity's label in the closed vocabulary, else its name, trimmed."""
    n, out = F.lower(F.trim(name)), None
    for parts, label in CANONICAL:
        fits = F.lit(False)
        for p in parts:
            fits |= n.contains(p)
        out = F.when(fits, label) if out is None else out.when(fits, label)
    return out.otherwise(F.trim(name))


def distinct_plans(listed: Column, least: Column) -> Column:
    """The plans of a list, trimmed, without blanks and repeats, in order; without any the least plan alone, if there is one."""
    held = F.array_distinct(F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != ""))
    one = F.nullif(F.trim(least), F.lit(""))
    return F.when(F.size(held) > 0, held).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))


def least_rank(plans: Column, ranks: dict[str, int]) -> Column:
    """The least known rank of an array of plans, else UNKNOWN_RANK."""
    known = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.coalesce(F.array_min(F.transform(plans, lambda p: F.try_element_at(known, p))), F.lit(UNKNOWN_RANK))


def label_of(key: Column, labels: dict[str, str], default: str) -> Column:
    """The label of an id in a dictionary, else a default."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key.cast("string")), F.lit(default))


def plan_allows(least: Column, user: Column) -> Column:
    """Whether a user's plan ranks as high as the least plan that an offer asks for."""
    return plan_rank(least) <= plan_rank(user)


def credits_of(credits: Column, plan: Column) -> Column:
    """Stated credits, else the first number in the plan's name."""
    return F.coalesce(credits, first_integer(plan))
