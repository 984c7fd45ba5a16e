"""Free-text questions to filters: municipio, modalidade, plano_rank and a confidence, over a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import none_if_blank, squeeze

# Aliases of cities in order of precedence; those of SHORT count as whole words only.
CITIES = [
    ("sao jose dos campos", "São José dos Campos"), ("sao jose do rio preto", "São José do Rio Preto"), ("sao bernardo do campo", "São Bernardo do Campo"),
    ("rio de janeiro", "Rio de Janeiro"), ("belo horizonte", "Belo Horizonte"), ("porto alegre", "Porto Alegre"), ("campo grande", "Campo Grande"),
    ("joao pessoa", "João Pessoa"), ("boa vista", "Boa Vista"), ("rio branco", "Rio Branco"), ("santo andre", "Santo André"), ("ribeirao preto", "Ribeirão Preto"),
    ("sao paulo", "São Paulo"), ("sao luis", "São Luís"), ("sao vicente", "São Vicente"), ("florianopolis", "Florianópolis"), ("campinas", "Campinas"),
    ("curitiba", "Curitiba"), ("salvador", "Salvador"), ("fortaleza", "Fortaleza"), ("recife", "Recife"), ("brasilia", "Brasília"), ("goiania", "Goiânia"),
    ("manaus", "Manaus"), ("belem", "Belém"), ("vitoria", "Vitória"), ("teresina", "Teresina"), ("natal", "Natal"), ("maceio", "Maceió"), ("aracaju", "Aracaju"),
    ("cuiaba", "Cuiabá"), ("palmas", "Palmas"), ("macapa", "Macapá"), ("sorocaba", "Sorocaba"), ("santos", "Santos"), ("osasco", "Osasco"),
    ("guarulhos", "Guarulhos"), ("piracicaba", "Piracicaba"), ("bauru", "Bauru"), ("jundiai", "Jundiaí"), ("niteroi", "Niterói"), ("aruja", "Arujá"),
    ("cotia", "Cotia"), ("ferraz de vasconcelos", "Ferraz de Vasconcelos"), ("itaquaquecetuba", "Itaquaquecetuba"), ("mairipora", "Mairiporã"),
    ("embu das artes", "Embu das Artes"), ("sampa", "São Paulo"), ("floripa", "Florianópolis"), ("cps", "Campinas"), ("sjc", "São José dos Campos"),
    ("poa", "Porto Alegre"), ("ssa", "Salvador"), ("bsb", "Brasília"), ("gyn", "Goiânia"), ("bh", "Belo Horizonte"), ("rj", "Rio de Janeiro"),
    ("rp", "Ribeirão Preto"), ("sp", "São Paulo"),
]
SHORT = {"cps", "sjc", "poa", "ssa", "bsb", "gyn", "bh", "rj", "rp", "sp"}
# Patterns of activities on the raw text, first match wins; < and > stand for ASCII word ends.
ACTIVITIES = [
    (r"<muay\s*thai>", "muay_thai"), (r"<jiu[-\s]?jitsu>|<bjj>", "jiu_jitsu"), (r"<pole\s*dance>|<pole>", "pole_dance"), (r"<cross\s*fit>", "crossfit"),
    (r"<muscula", "musculacao"), (r"<spinning>", "spinning"), (r"<pilates>", "pilates"), (r"<nata[cç][aã]o>|<swim>", "natacao"), (r"<funcional>", "funcional"),
    (r"<yoga>", "yoga"), (r"<boxe>", "boxe"), (r"<dan[cç]a>", "danca"), (r"<beach\s*tennis>", "beach_tennis"), (r"<fisio", "fisioterapia"), (r"<spa>", "spa"),
]
# Plan aliases in order and their ranks.
PLANS = [
    ("tp go", 1), ("tp5+", 8), ("tp 5+", 8), ("tp1+", 3), ("tp 1+", 3), ("tp2+", 4), ("tp 2+", 4), ("tp0", 1), ("tp7", 10), ("tp 7", 10), ("tp6", 9),
    ("tp 6", 9), ("tp5", 7), ("tp 5", 7), ("tp4", 6), ("tp 4", 6), ("tp3", 5), ("tp 3", 5), ("tp2", 4), ("tp 2", 4), ("tp1", 2), ("tp 1", 2),
]
INTERIOR = r"<interior\s+de\s+(sp|rj|mg|pr|rs|ba|pe|ce|go|df)>"


def ascii_words(pattern: str, ignore_case: bool = False) -> str:
    """< and > as ends of ASCII words, which Java's own word boundary is not."""
    return ("(?i)" if ignore_case else "") + pattern.replace("<", "(?<![A-Za-z0-9_])").replace(">", "(?![A-Za-z0-9_])")


def _city(q: Column) -> Column:
    """The label of the alias that begins first; the list's order breaks ties.

    The place of a whole-word alias is its first occurrence even inside a word.
    """
    interior = q.rlike(ascii_words(INTERIOR))
    found = []
    for order, (alias, label) in enumerate(CITIES):
        there = q.rlike(f"(?:^|[^a-z0-9]){alias}(?:[^a-z0-9]|$)") if alias in SHORT else F.contains(q, F.lit(alias))
        if alias in ("sp", "rj"):
            there &= ~interior
        found.append(F.when(there, F.struct(F.instr(q, alias).alias("at"), F.lit(order).alias("order"), F.lit(label).alias("label"))))
    named = F.array_min(F.array_compact(F.array(*found)))["label"]
    state = q.rlike(ascii_words("<sp>")) | F.contains(q, F.lit("sao paulo")) | ~F.replace(q, F.lit("capital"), F.lit("")).rlike(ascii_words("<[a-z]{2}>"))
    return F.coalesce(named, F.when(q.rlike(ascii_words("<capital>")) & state, F.lit("São Paulo")))


def _plan(q: Column) -> Column:
    out = F.when(q.rlike(ascii_words(r"<tp\s*5\+")), F.lit(8)).when(q.rlike(ascii_words(r"<tp\s*1\+")), F.lit(3)).when(q.rlike(ascii_words(r"<tp\s*go>")), F.lit(1))
    for alias, rank in PLANS:
        there = F.contains(q, F.lit(alias))
        if not alias.endswith("+"):
            for longer, _ in PLANS:
                if longer != alias and longer.startswith(alias):
                    there &= ~F.contains(q, F.lit(longer))
        out = out.when(there, F.lit(rank))
    return out


def extract_filters(query: Column, municipio: Column | None = None, modalidade: Column | None = None, plano_rank: Column | None = None) -> Column:
    """struct(municipio, modalidade, plano_rank, confidence); given values win unless blank or null."""
    q = squeeze(query)
    activity = F.lit(None).cast("string")
    for pattern, label in reversed(ACTIVITIES):
        activity = F.when(query.rlike(ascii_words(pattern, ignore_case=True)), F.lit(label)).otherwise(activity)
    city, plan = _city(q), _plan(q)
    if municipio is not None:
        city = F.coalesce(none_if_blank(municipio), city)
    if modalidade is not None:
        activity = F.coalesce(none_if_blank(modalidade), activity)
    if plano_rank is not None:
        plan = F.coalesce(plano_rank, plan)
    filled = sum((c.isNotNull().cast("int") for c in (city, activity, plan)), F.lit(0))
    sure = F.element_at(F.array(*[F.lit(x) for x in (0.1, 0.6, 0.75, 0.9)]), filled + 1)
    return F.struct(city.alias("municipio"), activity.alias("modalidade"), plan.cast("int").alias("plano_rank"), sure.alias("confidence"))
