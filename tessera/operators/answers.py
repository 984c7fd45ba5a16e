"""Rule-based answers to a whole table of questions over an index of offers, in one plan.

What a question wants is found by ordered rules on its words, and how far its plan goes by its
credits or rank. All that an answer needs is worked out beforehand for each different limit that
the questions name: counts and the cheapest offer come from sums by credits or rank, of which
there are as many as there are different values, so a question costs two joins on its limit and
no look at the offers. Lists are a table of their own, (kind, limit_key, place, line): questions
with the same limit share one list, however long it is.

Offers (ord, name, bairro, plan, need, price, listed) are in the order of ord, which is unique;
those that aren't ``listed`` count among all offers only. A null need passes without a limit only.
Null questions are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.classify import asked_credits, asked_plan, credits_of, plan_rank
from tessera.functions.text import credits_price
from tessera.operators.knowledge import filled, number
from tessera.session import cut

NO_PRICE = 9e9
# Words that show what a question wants.
PRICE, LISTING, CHEAP, DISTRICT, NAMED = "valor|pre[cç]o|custa|quanto", "academ|aceit|lista|quais", "barat|menor pre", "coco|cocó", "crossfit aldeota"
CATALOG, NETWORK = "valor|pre[cç]o|tabela|cat[aá]logo", r"total\s*pass|(?:^|[^A-Za-z0-9_])tp(?:$|[^A-Za-z0-9_])"


def offer_line(name: Column, bairro: Column, plan: Column, price: Column, place_missing: str | None = "?") -> Column:
    """'• name (district) — plan / R$price'; without place_missing an unknown district is left out."""
    where = F.concat(F.lit(" ("), filled(bairro), F.lit(")"))
    where = F.coalesce(where, F.lit("" if place_missing is None else f" ({place_missing})"))
    return F.concat(F.lit("• "), name, where, F.lit(" — "), F.coalesce(filled(plan), F.lit("?")), F.lit(" / R$"), F.coalesce(number(price), F.lit("?")))


def gym_offers(gyms: DataFrame) -> DataFrame:
    """Offers of gyms (ord, name, bairro, plano_minimo, creditos_minimos, valor_mensal_brl); listed are those that state a plan, credits or price."""
    need = credits_of(F.col("creditos_minimos"), F.col("plano_minimo")).cast("double")
    listed = F.coalesce(F.col("plano_minimo").cast("string"), F.col("creditos_minimos").cast("string"), F.col("valor_mensal_brl").cast("string")).isNotNull()
    held = gyms.select("ord", "name", "bairro", F.col("plano_minimo").alias("plan"), need.alias("need"), F.col("valor_mensal_brl").cast("double").alias("price"), listed.alias("listed"))
    return held.withColumn("line", offer_line(F.col("name"), F.col("bairro"), F.col("plan"), F.col("price"))).withColumn("local", F.coalesce(F.lower("bairro").contains("coco"), F.lit(False)))


def partner_offers(partners: DataFrame) -> DataFrame:
    """Offers of partners (ord, name, bairro, plan_minimo, price_brl_month); listed are those with a plan."""
    held = partners.select("ord", "name", "bairro", F.col("plan_minimo").alias("plan"), plan_rank(F.col("plan_minimo")).cast("double").alias("need"), F.col("price_brl_month").cast("double").alias("price"), filled(F.col("plan_minimo")).isNotNull().alias("listed"))
    local = F.lower(F.coalesce(filled(F.col("bairro")), F.col("name"), F.lit(""))).contains("coco")
    return held.withColumn("line", offer_line(F.col("name"), F.col("bairro"), F.col("plan"), F.col("price"), None)).withColumn("local", local)


def limits_of(questions: DataFrame) -> DataFrame:
    """(limit_key, most): the different limits of questions (…, most double); none has the key 'all'."""
    return questions.select(_key(F.col("most")).alias("limit_key"), "most").distinct()


def _key(most: Column) -> Column:
    return F.coalesce(number(most), F.lit("all"))


def ladder(offers: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_key, offers, cheapest, local_offers): of the listed offers within each limit the number, the line of the first cheapest, and how many are local.

    Offers are summed by need, and running sums over these, one row for each different need or
    limit, give each limit its numbers.
    """
    cheapest = F.min(F.struct(F.coalesce("price", F.lit(NO_PRICE)).alias("price"), "ord", "line"))
    steps = offers.where("listed").groupBy("need").agg(F.count(F.lit(1)).alias("n"), cheapest.alias("best"), F.count_if("local").alias("local_n"))
    whole = steps.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("best").alias("best"), F.coalesce(F.sum("local_n"), F.lit(0)).alias("local_n"))
    asked = limits.where("most is not null").select(F.col("most").alias("need"), F.lit(0).cast("long").alias("n"), F.lit(None).cast(steps.schema["best"].dataType).alias("best"), F.lit(0).cast("long").alias("local_n"), "limit_key")
    both = steps.where("need is not null").withColumn("limit_key", F.lit(None).cast("string")).unionByName(asked)
    # One row a different need: there is nothing to part it by, and no more rows than plans or credits have values.
    upto = Window.orderBy("need").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = both.select("limit_key", F.sum("n").over(upto).alias("n"), F.min("best").over(upto).alias("best"), F.sum("local_n").over(upto).alias("local_n")).where("limit_key is not null")
    every = whole.select(F.lit("all").alias("limit_key"), "n", "best", "local_n")
    return run.unionByName(every).select("limit_key", F.col("n").alias("offers"), F.col("best.line").alias("cheapest"), F.col("local_n").alias("local_offers"))


def lines(offers: DataFrame, limits: DataFrame, kind: str, local_only: bool = False) -> DataFrame:
    """(kind, limit_key, place, line): the listed offers within each limit, in order, place being their ord."""
    held = offers.where(F.col("listed") & (F.col("local") if local_only else F.lit(True)))
    named = F.broadcast(limits.where("most is not null")) if limits.limit(10_001).count() <= 10_000 else limits.where("most is not null")
    some = held.join(named, F.col("need") <= F.col("most")).select("limit_key", F.col("ord").alias("place"), "line")
    if limits.where("most is null").count():
        some = some.unionByName(held.select(F.lit("all").alias("limit_key"), F.col("ord").alias("place"), "line"))
    return some.select(F.lit(kind).alias("kind"), "limit_key", "place", "line")


def _asked(questions: DataFrame, most: Column, *more: str) -> DataFrame:
    q = F.lower(F.coalesce("question", F.lit("")))
    return questions.select("question_id", q.alias("q"), most.cast("double").alias("most"), *more).withColumn("limit_key", _key(F.col("most")))


def answer_gyms(questions: DataFrame, gyms: DataFrame, hint: str = "") -> tuple[DataFrame, DataFrame]:
    """((question_id, intent, text, kind, limit_key), lines) of questions (question_id, question) over gyms.

    The text is the answer's own words; where kind isn't null, the lines of that kind and limit follow.
    hint is what a question gets that fits no rule, or a standing one where it is empty.
    """
    offers = gym_offers(gyms)
    asked = _asked(questions, asked_credits(F.col("question")))
    limits = cut(limits_of(asked))
    totals = offers.agg(F.count(F.lit(1)).alias("all"), F.count_if("listed").alias("listed")).first()
    first = offers.where("listed and need is not null").groupBy("need").agg(F.min(F.struct("ord", "name", "price")).alias("seen"))
    named = offers.where(F.lower("name").contains(NAMED)).agg(F.min(F.struct("ord", "plan", "need", "price", "line")).alias("g")).select("g.*").first()
    held = asked.join(cut(ladder(offers, limits)), "limit_key", "left").join(first, F.col("most") == F.col("need"), "left")
    has = lambda pattern: F.col("q").rlike(pattern)
    stated = F.col("most").isNotNull()
    credits = number(F.col("most"))
    intent = (
        F.when(F.lit(totals["all"] == 0), "empty").when(F.lit(totals["listed"] == 0), "no_plans").when(has(PRICE) & stated & ~has(LISTING), "price").when(has(DISTRICT), "district")
        .when(has(CHEAP), "cheapest").when(has(NAMED), "named").when(has("quais|lista|aceit|gurupass|academ") | stated, "list").otherwise("hint")
    )
    price = F.format_string("%.2f", F.coalesce("seen.price", credits_price(F.col("most"))))
    source = F.when(F.col("seen.name").isNotNull(), F.concat(F.lit(" (visto em "), "seen.name", F.lit(")"))).otherwise(F.lit(" (tabela R$4,95/crédito)"))
    if named is None or named["ord"] is None:
        about = F.lit("Crossfit Aldeota não está no índice.")
    else:
        least = 70.0 if named["need"] is None else named["need"]
        refused = F.concat(F.lit(f"Crossfit Aldeota exige {named['plan'] if named['plan'] is not None else 'null'} (R$"), F.coalesce(number(F.lit(named["price"]).cast("double")), F.lit("null")), F.lit("). Seu plano ("), credits, F.lit(" créditos) NÃO cobre."))
        about = F.when(stated & (F.col("most") < least), refused).otherwise(F.lit(named["line"]))
    header = F.when(stated, F.concat(F.lit("Gurupass com ≤"), credits, F.lit(" créditos: "), F.col("offers").cast("string"), F.lit(f"/{totals['listed']} academias"))).otherwise(F.concat(F.lit("Gurupass indexado: "), F.col("offers").cast("string"), F.lit(" academias")))
    cheapest = F.concat(F.lit("Mais barata no filtro"), F.coalesce(F.concat(F.lit(" (≤"), credits, F.lit(" créditos)")), F.lit("")), F.lit(":\n"), F.col("cheapest"))
    text = (
        F.when(F.col("intent") == "empty", "Agente publicado sem academias indexadas. Rode Treinar & Publicar (seed Fortaleza).")
        .when(F.col("intent") == "no_plans", f"Índice inválido para planos: {totals['all']} academias SEM plano_minimo/preço (seed sintético Cocó?).\nRe-treine: Treinar & Publicar SEM upload — usa /knowledge/gp-accept-fortaleza.json\nNomes no índice agora:")
        .when(F.col("intent") == "price", F.concat(F.lit("Ilimitado "), credits, F.lit(" = R$"), price, F.lit("/mês"), source, F.lit(".")))
        .when(F.col("intent") == "district", F.when(F.col("local_offers") > 0, "").otherwise("Nenhuma academia indexada com bairro Cocó neste agente. Snapshot atual é Fortaleza city-wide."))
        .when(F.col("intent") == "cheapest", F.coalesce(cheapest, F.lit("Nenhuma academia no filtro do seu plano.")))
        .when(F.col("intent") == "named", about)
        .when(F.col("intent") == "list", F.when(F.col("offers") > 0, header).otherwise(F.concat(header, F.lit("\n(nenhuma no filtro)"))))
        .otherwise(hint or "Pergunte: lista Gurupass, bairro, plano (ex. Ilimitado 35), ou academia específica.")
    )
    kind = F.when((F.col("intent") == "list") & (F.col("offers") > 0), "list").when((F.col("intent") == "district") & (F.col("local_offers") > 0), "district").when(F.col("intent") == "no_plans", "names")
    key = F.when(F.col("intent") == "no_plans", "all").otherwise(F.col("limit_key"))
    out = held.withColumn("intent", intent).select("question_id", "intent", text.alias("text"), kind.alias("kind"), key.alias("limit_key"))
    names = offers.where(F.lit(totals["listed"] == 0)).select(F.lit("names").alias("kind"), F.lit("all").alias("limit_key"), F.col("ord").alias("place"), F.col("name").alias("line"))
    return out, lines(offers, limits, "list").unionByName(lines(offers, limits, "district", True)).unionByName(names)


def answer_partners(questions: DataFrame, partners: DataFrame, catalog: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The same over partners, whose plans rank; catalog is the text of the price table, if there is one."""
    offers = partner_offers(partners.where("coalesce(name, '') <> ''"))
    plan = asked_plan(F.col("question"))
    asked = _asked(questions.withColumn("plan_asked", plan), F.when(F.col("plan_asked").isNotNull(), plan_rank(F.col("plan_asked"))), "plan_asked")
    limits = cut(limits_of(asked))
    count = offers.count()
    held = asked.join(cut(ladder(offers, limits)), "limit_key", "left")
    has = lambda pattern: F.col("q").rlike(pattern)
    stated, local = F.col("plan_asked").isNotNull(), F.col("local_offers") > 0
    intent = (
        F.when(F.lit(count == 0), "empty").when(has(DISTRICT) & ~local & has(r"total\s*pass|tp(?:$|[^A-Za-z0-9_])"), "network").when(has(DISTRICT), "district").when(has(CHEAP), "cheapest")
        .when(F.lit(catalog is not None) & has(CATALOG), "catalog").when(has("quais|lista|aceit|academ|" + NETWORK) | stated, "list").otherwise("hint")
    )
    some = F.col("offers").cast("string")
    within = F.concat(F.lit("≤"), F.col("plan_asked"))
    header = F.when(stated, F.concat(F.lit("TotalPass com "), within, F.lit(": "), some, F.lit(f"/{count}"))).otherwise(F.concat(F.lit("TotalPass indexado: "), some, F.lit(" academias")))
    text = (
        F.when(F.col("intent") == "empty", "Sem partners TotalPass no índice. Faça upload de tp-partner-enrich-*.json ou artefato ingest TP.")
        .when(F.col("intent") == "network", F.concat(F.lit("TotalPass (fixture Cocó / partners): "), some, F.lit(" academias"), F.coalesce(F.concat(F.lit(" com "), within), F.lit(""))))
        .when(F.col("intent") == "district", F.when(local, "").otherwise("Nenhum partner TP com bairro Cocó no meta."))
        .when(F.col("intent") == "cheapest", F.coalesce(F.concat(F.lit("Mais barata no filtro:\n"), F.col("cheapest")), F.lit("Nenhuma no filtro.")))
        .when(F.col("intent") == "catalog", F.lit(catalog))
        .when(F.col("intent") == "list", F.when(F.col("offers") > 0, header).otherwise(F.concat(header, F.lit("\n(nenhuma)"))))
        .otherwise(catalog or "Pergunte: lista TotalPass, TP3, Cocó, ou preço tabela.")
    )
    kind = F.when(F.col("intent").isin("list", "network") & (F.col("offers") > 0), "list").when((F.col("intent") == "district") & local, "district")
    out = held.withColumn("intent", intent).select("question_id", "intent", text.alias("text"), kind.alias("kind"), "limit_key")
    return out, lines(offers, limits, "list").unionByName(lines(offers, limits, "district", True))
