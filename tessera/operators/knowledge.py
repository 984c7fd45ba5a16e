"""Chunks from JSON payloads of several kinds, and records back from chunks.

A payload is one JSON document. Which builder it gets hangs on the keys it has; every builder is
an expression over the parsed payload, so a table of payloads becomes chunks in one pass, without
a shuffle. Numbers in texts look as JavaScript prints them, a missing value as null; lengths are
code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.classify import credits_of, distinct_plans, district_before, label_of, least_rank
from tessera.functions.text import brl, ellipsis, slug

_GYM = "nome:string,name:string,bairro:string,endereco:string,address:string,cidade:string,uf:string,plano_minimo:string,creditos_minimos:double,valor_mensal_brl:double,modalidades:array<string>"
_HINT = "struct<plan_minimo:string,price_brl_month:double,modalities:array<string>>"
_PAGE = "title:string,name:string,id:string,text:string,body:string,content:string,markdown:string,url:string,source:string"
#: What a payload is read for.
PAYLOAD = f"""aggregator string, ingest_kind string, domain string, kind string, title string, text string,
academias array<struct<{_GYM}>>, items array<struct<{_GYM}>>, accept_list array<struct<{_GYM}>>,
partners array<struct<name:string,slug:string,url:string,plan_hint:{_HINT},comodidades:array<string>,totalpass_hit:boolean>>, catalog_prices_brl map<string,double>,
geo_sample struct<items:array<struct<name:string,bairro:string,totalpass_hit:boolean,plan_hint:{_HINT}>>>,
pages array<struct<{_PAGE}>>, documents array<struct<{_PAGE}>>, laws array<struct<{_PAGE}>>, normas array<struct<{_PAGE}>>,
rag_chunks array<struct<id:string,type:string,text:string>>"""
CHUNK = "array<struct<chunk_id:string,chunk_type:string,text:string,meta:string>>"
SLICE, BLOB = 1200, 8000


def filled(*xs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in xs])


def number(x: Column) -> Column:
    """A double as JavaScript prints it: the shortest digits that give it back, without an exponent from 1e-6 up to 1e21."""
    x = x.cast("double")
    size = F.abs(x)
    digits = lambda kind: F.regexp_replace(x.cast("string").cast(kind).cast("string"), r"\.?0+$", "")
    power = F.regexp_replace(F.regexp_replace(F.replace(x.cast("string"), F.lit(".0E"), F.lit("E")), "E-", "e-"), "E", "e+")
    return F.when(size == 0, "0").when((size >= 1e-6) & (size < 1), digits("decimal(38,30)")).when((size >= 1) & (size < 1e21), digits("decimal(38,16)")).otherwise(power)


def _said(x: Column, missing: str = "null") -> Column:
    return F.coalesce(x, F.lit(missing))


def detect_domain(doc: Column) -> Column:
    """The domain of a payload by the keys that it has, the first rule that fits."""
    kind = F.lower(F.coalesce(filled(doc["aggregator"], doc["ingest_kind"]), F.lit("")))
    has = lambda *names: F.coalesce(*[doc[n].cast("string") for n in names]).isNotNull()
    legal = F.coalesce(doc["domain"] == "regulatory", F.lit(False))
    # The words that name a domain.
    return (
        F.when(kind.contains("gurupass") | has("academias"), "gurupass").when(kind.contains("totalpass") | has("partners"), "totalpass").when(kind.contains("wellhub"), "wellhub")
        .when(kind.contains("regulator") | legal | F.coalesce(doc["kind"] == "regulatory", F.lit(False)) | has("laws", "normas"), "regulatory")
        .when(has("pages", "documents", "text"), "generic").when(has("accept_list"), "gurupass").otherwise("generic")
    )


def _chunk(chunk_id: Column, kind: Column | str, text: Column, **meta: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(chunk_id.alias("chunk_id"), kind.alias("chunk_type"), text.alias("text"), F.to_json(F.struct(*[v.alias(k) for k, v in meta.items()])).alias("meta"))


def _when(condition: Column, chunks: Column) -> Column:
    return F.when(condition, chunks).otherwise(F.array()).cast(CHUNK)


def _each(items: Column, build) -> Column:
    return F.coalesce(F.transform(items, build), F.array()).cast(CHUNK)


def _rag(doc: Column, before: Column, source_ref: Column, domain: Column) -> Column:
    """Ready chunks that have a text; those without an id are named after their place among all chunks."""
    held = F.filter(doc["rag_chunks"], lambda r: filled(r["text"]).isNotNull())
    named = lambda r, i: F.coalesce(filled(r["id"]), F.concat(F.lit("rag-"), (before + i).cast("string")))
    return F.coalesce(F.transform(held, lambda r, i: _chunk(named(r, i), F.coalesce(filled(r["type"]), F.lit("rag")), r["text"], source_ref=source_ref, domain=domain)), F.array()).cast(CHUNK)


def gym_chunks(doc: Column, source_ref: Column, city: str = "Fortaleza", state: str = "CE") -> Column:
    """Chunks of an accept list with its ready chunks, or else of a page export with a summary.

    A gym's fields stand in the metadata themselves and once more as the gym, there with the credits that its plan implies.
    """

    def line(name: Column, district: Column, plan: Column, price: Column, *more: Column) -> Column:
        return F.concat_ws(" | ", name, _said(filled(district), "?"), _said(plan), F.concat(F.lit("R$"), _said(number(price))), *more)

    domain, names = F.lit("gurupass"), [f.split(":")[0] for f in _GYM.split(",")]

    def accepted(g: Column) -> Column:
        credits = credits_of(g["creditos_minimos"], g["plano_minimo"]).cast("double")
        text = line(g["name"], g["bairro"], g["plano_minimo"], g["valor_mensal_brl"], F.concat(F.lit("créditos≥"), _said(number(credits))))
        own = {n: g[n] for n in names}
        gym = F.struct(*[(credits if n == "creditos_minimos" else g[n]).alias(n) for n in names])
        return _chunk(F.concat(F.lit("gp-gym-"), slug(g["name"])), "gp_gym", text, **own, gym=gym, source_ref=source_ref, domain=domain)

    def exported(g: Column) -> Column:
        name = F.coalesce(filled(g["nome"], g["name"]), F.lit("sem-nome"))
        district = F.coalesce(filled(g["bairro"]), district_before(F.coalesce(filled(g["endereco"], g["address"]), F.lit(""))))
        plan = filled(g["plano_minimo"])
        own = {"name": name, "bairro": district, "cidade": F.lit(city), "uf": F.lit(state), "plano_minimo": plan, "creditos_minimos": credits_of(F.lit(None), plan).cast("double"), "valor_mensal_brl": g["valor_mensal_brl"], "modalidades": F.coalesce(g["modalidades"], F.array().cast("array<string>"))}
        gym = F.struct(*[v.alias(n) for n, v in own.items()])
        return _chunk(F.concat(F.lit("gp-gym-"), slug(name)), "gp_gym", line(name, district, plan, g["valor_mensal_brl"]), **own, gym=gym, source_ref=source_ref, domain=domain)

    listed = F.concat(_each(doc["accept_list"], accepted), _rag(doc, F.size(doc["accept_list"]), source_ref, domain))
    pages = F.coalesce(doc["academias"], doc["items"])
    words = F.concat(F.lit(f"Gurupass {city}: "), F.size(pages).cast("string"), F.lit(" academias indexadas (plano_minimo + preço)."))
    summary = F.array(_chunk(F.concat(F.lit("gp-summary-"), slug(F.lit(city))), "summary", words, source_ref=source_ref, domain=domain)).cast(CHUNK)
    return F.when(doc["accept_list"].isNotNull(), listed).when(pages.isNotNull(), F.concat(_each(pages, exported), summary)).otherwise(F.array().cast(CHUNK))


def partner_chunks(doc: Column, source_ref: Column) -> Column:
    """A price list, a chunk for each partner, a summary, and the partners of a geographic sample."""
    prices, partners = doc["catalog_prices_brl"], doc["partners"]
    domain = F.lit("totalpass")
    listed = F.array_join(F.transform(F.map_entries(prices), lambda e: F.concat(e["key"], F.lit("=R$"), _said(number(e["value"])))), "; ")
    catalog = F.array(_chunk(F.lit("tp-catalog-prices"), "tp_catalog", F.concat(F.lit("TotalPass preços: "), listed), domain=domain, catalog_prices_brl=prices, source_ref=source_ref))

    def partner(p: Column) -> Column:
        name, hint = F.coalesce(filled(p["name"], p["slug"]), F.lit("partner")), p["plan_hint"]
        plan = F.coalesce(hint["plan_minimo"], F.lit(""))
        price = F.coalesce(hint["price_brl_month"], F.try_element_at(prices, F.regexp_replace(plan, r"\s+", "")), F.try_element_at(prices, plan))
        extras = F.array_join(F.slice(F.coalesce(p["comodidades"], F.array().cast("array<string>")), 1, 6), ", ")
        text = F.concat(name, F.lit(" TotalPass | plano_minimo="), plan, F.lit(" | R$"), _said(number(price), "?"), F.lit(" | "), extras)
        none = F.array().cast("array<string>")
        held = F.struct(
            name.alias("name"), p["slug"].alias("slug"), p["url"].alias("url"), plan.alias("plan_minimo"), price.alias("price_brl_month"),
            F.coalesce(hint["modalities"], none).alias("modalidades"), F.coalesce(p["comodidades"], none).alias("comodidades"), F.coalesce(p["totalpass_hit"], F.lit(True)).alias("totalpass_hit"),
        )
        return _chunk(F.concat(F.lit("tp-partner-"), slug(name)), "tp_partner", text, domain=domain, partner=held, source_ref=source_ref)

    summary = F.array(_chunk(F.lit("tp-summary"), "summary", F.concat(F.lit("TotalPass: "), F.size(partners).cast("string"), F.lit(" partners indexados (plan_minimo + preço).")), domain=domain, source_ref=source_ref))

    def sampled(x: Column) -> Column:
        name, hint = F.coalesce(filled(x["name"]), F.lit("gym")), x["plan_hint"]
        text = F.concat(name, F.lit(" | "), _said(filled(x["bairro"]), "?"), F.lit(" | "), _said(filled(hint["plan_minimo"]), "?"), F.lit(" | R$"), _said(number(hint["price_brl_month"]), "?"))
        held = F.struct(name.alias("name"), x["bairro"].alias("bairro"), hint["plan_minimo"].alias("plan_minimo"), hint["price_brl_month"].alias("price_brl_month"))
        return _chunk(F.concat(F.lit("tp-geo-"), slug(name)), "tp_partner", text, domain=domain, partner=held, source_ref=source_ref)

    hits = F.filter(doc["geo_sample"]["items"], lambda x: F.coalesce(x["totalpass_hit"], F.lit(False)) | x["plan_hint"].isNotNull())
    return F.concat(_when(F.size(F.coalesce(F.map_keys(prices), F.array().cast("array<string>"))) > 0, catalog), _each(partners, partner), _when(F.size(F.coalesce(partners, F.array())) > 0, summary), _each(hits, sampled))


def page_chunks(doc: Column, source_ref: Column, domain: Column) -> Column:
    """Pages, documents, laws or rules in slices under their titles, and a text of the payload's own."""
    kind = F.when(domain == "regulatory", "law_chunk").otherwise("doc_chunk")

    def page(p: Column) -> Column:
        title = F.coalesce(filled(p["title"], p["name"], p["id"]), F.lit("documento"))
        body = F.coalesce(filled(p["text"], p["body"], p["content"], p["markdown"]), F.lit(""))
        slices = F.when(F.trim(F.regexp_replace(body, r"\s+", " ")) != "", F.regexp_extract_all(body, F.lit(f"(?s).{{1,{SLICE}}}"), F.lit(0))).otherwise(F.array())
        named = lambda i: F.concat(domain, F.lit("-"), slug(title), F.lit("-"), i.cast("string"))
        return F.transform(slices, lambda s, i: _chunk(named(i), kind, F.concat(title, F.lit("\n"), s), domain=domain, title=title, url=filled(p["url"], p["source"]), part=i, source_ref=source_ref))

    pages = F.coalesce(doc["pages"], doc["documents"], doc["laws"], doc["normas"])
    title = F.coalesce(filled(doc["title"]), F.lit("texto"))
    own = F.array(_chunk(F.concat(domain, F.lit("-"), slug(title), F.lit("-0")), kind, F.concat(title, F.lit("\n"), doc["text"]), domain=domain, title=title, source_ref=source_ref))
    has_text = F.coalesce(F.trim(F.regexp_replace(doc["text"], r"\s+", " ")) != "", F.lit(False))
    return F.concat(F.coalesce(F.flatten(F.transform(pages, page)), F.array()).cast(CHUNK), _when(has_text, own))


def generic_chunks(doc: Column, raw: Column, source_ref: Column) -> Column:
    """Ready chunks, or the payload's own JSON as one."""
    domain = F.lit("generic")
    ready = _rag(doc, F.lit(0), source_ref, domain)
    blob = F.array(_chunk(F.lit("generic-json-0"), "raw_json", F.substring(raw, 1, BLOB), domain=domain, source_ref=source_ref)).cast(CHUNK)
    return F.when(F.size(ready) > 0, ready).otherwise(blob)


def chunks_of(payloads: DataFrame) -> DataFrame:
    """(source_ref, domain, ord, chunk_id, chunk_type, text, meta) of payloads (source_ref, payload).

    meta is JSON without nulls; each has its domain, which for ready chunks and raw payloads of the
    general kind is generic whatever their pages' domain. Of a general payload's chunks with one id the first stays. A payload that isn't a JSON object counts as an empty one.
    """
    parsed = payloads.select("source_ref", "payload", F.coalesce(F.from_json("payload", PAYLOAD), F.from_json(F.lit("{}"), PAYLOAD)).alias("doc"))
    parsed = parsed.withColumn("domain", detect_domain(F.col("doc")))
    doc, raw, ref, domain = F.col("doc"), F.coalesce("payload", F.lit("{}")), F.col("source_ref"), F.col("domain")
    legal = page_chunks(doc, ref, F.lit("regulatory"))
    general = F.concat(page_chunks(doc, ref, F.when(domain == "wellhub", "wellhub").otherwise("generic")), generic_chunks(doc, raw, ref))
    built = F.when(domain == "gurupass", gym_chunks(doc, ref)).when(domain == "totalpass", partner_chunks(doc, ref)).when(domain == "regulatory", F.when(F.size(legal) > 0, legal).otherwise(generic_chunks(doc, raw, ref))).otherwise(general)
    out = parsed.select("source_ref", "domain", built.alias("built")).select("source_ref", "domain", "built", F.transform("built", lambda c: c["chunk_id"]).alias("ids"))
    first = F.filter(F.transform("built", lambda c, i: F.struct(i.alias("ord"), c.alias("c"))), lambda x: F.col("domain").isin("gurupass", "totalpass", "regulatory") | (F.array_position("ids", x["c"]["chunk_id"]) == x["ord"] + 1))
    return out.select("source_ref", "domain", F.explode(first).alias("x")).select("source_ref", "domain", "x.ord", "x.c.*")


def domains_in(chunks: DataFrame) -> DataFrame:
    """(domain, first): each domain once, by its first chunk's ``ord``; none counts as generic."""
    return chunks.groupBy(F.coalesce("domain", F.lit("generic")).alias("domain")).agg(F.min("ord").alias("first"))


def gyms_from_chunks(chunks: DataFrame) -> DataFrame:
    """Gym records of chunks (chunk_id, chunk_type, meta JSON): the gym in the metadata, or what gym chunks say of themselves."""
    gym = f"struct<{_GYM}>"
    m = F.from_json("meta", f"gym {gym}, {_GYM.replace(':', ' ').replace('array<string>', 'array<string>')}")
    held = chunks.select("chunk_id", "chunk_type", m.alias("m")).where("m.gym is not null or chunk_type = 'gp_gym' or coalesce(m.plano_minimo, '') <> ''")
    g = F.coalesce(F.col("m.gym"), F.struct(*[F.col(f"m.{c.split(':')[0]}") for c in _GYM.replace("array<string>", "array").split(",")]).cast(gym))
    own = F.col("m.gym").isNull()
    return held.select("chunk_id", own.alias("own"), g.alias("g")).select(
        F.coalesce(filled(F.col("g.name")), F.when(F.col("own"), F.col("chunk_id"))).alias("name"), "g.bairro", "g.cidade", "g.uf", "g.plano_minimo",
        F.when(F.col("own"), credits_of(F.col("g.creditos_minimos"), F.col("g.plano_minimo"))).otherwise(F.col("g.creditos_minimos")).cast("double").alias("creditos_minimos"), "g.valor_mensal_brl",
        F.coalesce("g.modalidades", F.array().cast("array<string>")).alias("modalidades"),
    )


def partners_from_chunks(chunks: DataFrame) -> DataFrame:
    """Partner records with a name of chunks (chunk_type, meta JSON)."""
    p = F.from_json("meta", "partner struct<name:string,slug:string,url:string,bairro:string,plan_minimo:string,price_brl_month:double>")["partner"]
    return chunks.where("chunk_type = 'tp_partner'").select(p.alias("p")).where("coalesce(p.name, '') <> ''").select("p.*")


def accept_artifact(items: DataFrame, city: str, state: str, district: str | None = None, user_credits: float | None = None, shown: int = 12) -> DataFrame:
    """(id, type, text, gp_accept_count): one chunk on the items (ord, name, plano_minimo, creditos_minimos, valor_mensal_brl) of a list, of which it names the first few by ord."""
    least = F.coalesce(filled(F.col("plano_minimo")), number(F.col("creditos_minimos").cast("double")), F.lit("null"))
    said = F.concat(F.coalesce("name", F.lit("null")), F.lit(" ≥"), least, F.lit(" R$"), _said(number(F.col("valor_mensal_brl").cast("double")), "?"))
    # Only the first few are gathered; the rest is counted.
    named = items.select("ord", said.alias("said")).orderBy("ord").limit(shown).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "said"))), lambda x: x["said"]), "; ").alias("named"))
    place = f"{district or 'cidade'} {city}-{state}"
    text = F.concat(F.lit(f"Gurupass {place}: "), F.col("n").cast("string"), F.lit(f" academias (user_credits={'any' if user_credits is None else f'{user_credits:g}'}) | "), F.col("named"))
    ids = F.concat(F.lit("gp-accept-"), slug(F.lit(city)), F.lit("-"), slug(F.lit(district or "city")))
    # One row on either side.
    return items.agg(F.count(F.lit(1)).alias("n")).join(named, F.lit(True)).select(ids.alias("id"), F.lit("gp_accept_plan_geo").alias("type"), text.alias("text"), F.col("n").alias("gp_accept_count"))


#: What fees and terms of a fee sheet are called.
FEES = {"alvara_funcionamento_brl": "Alvará de funcionamento (R$)", "taxa_bombeiros_brl": "Taxa de bombeiros (R$)", "projeto_arquitetonico_cau_brl": "Projeto arquitetônico CAU (R$)", "vistoria_sanitaria_brl": "Vistoria sanitária (R$)"}
TERMS = {"alvara": "Alvará", "bombeiros": "Bombeiros"}
_RANGE = "min:double,max:double,typico:double"
SHEET = f"cidade string, uf string, fonte string, data_coleta string, revisao_pendente boolean, notas string, taxas map<string,struct<{_RANGE},r_m2:struct<{_RANGE}>>>, prazo_meses_tipico map<string,double>"


def fee_sheets(sheets: DataFrame) -> DataFrame:
    """(slug, chunk_id, text, cidade, uf, fee_keys) of one city's fees each, sheets (slug, payload JSON)."""
    doc, name = F.col("doc"), F.col("slug")
    labelled = lambda labels, key: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in labels.items() for x in p]), key), key)
    said = lambda label, x: F.when(x.isNotNull(), F.concat(F.lit(label), x))

    def fee(e: Column) -> Column:
        low, high, usual = (brl(e["value"][k]) for k in ("min", "max", "typico"))
        one = F.coalesce(low == high, F.lit(False))
        area = F.concat_ws(" · ", *[said(label, brl(e["value"]["r_m2"][k])) for k, label in (("min", "mín "), ("max", "máx "), ("typico", "típico "))])
        ranges = F.concat_ws("\n", said("- Mínimo: ", low), said("- Máximo: ", high), said("- Típico: ", usual))
        body = F.when(one, F.concat(F.lit("- Valor: "), low)).otherwise(F.nullif(ranges, F.lit("")))
        return F.concat_ws("\n", F.concat(F.lit("### "), labelled(FEES, e["key"])), body, F.when(area != "", F.concat(F.lit("- R$/m²: "), area)))

    def term(e: Column) -> Column:
        return F.concat(F.lit("- "), labelled(TERMS, e["key"]), F.lit(": "), number(e["value"]), F.lit(" mês(es)"))

    def section(title: str, entries: Column, line) -> Column:
        return F.when(F.size(entries) > 0, F.concat(F.lit(title + "\n"), F.array_join(F.transform(F.map_entries(entries), line), "\n")))

    text = F.concat_ws(
        "\n", F.concat(F.lit("Taxas municipais para academia — "), doc["cidade"], F.lit("/"), doc["uf"]), F.concat(F.lit("Documento: "), name, F.lit(".json")),
        F.concat(F.lit("Fonte: "), F.coalesce(filled(doc["fonte"]), F.lit("não informada"))), F.concat(F.lit("Data da coleta: "), F.coalesce(filled(doc["data_coleta"]), F.lit("não informada"))),
        F.when(doc["revisao_pendente"], "Status: revisão pendente (estimativa piloto)").otherwise("Status: curado"), F.lit(""),
        F.concat(F.lit("Notas: "), filled(doc["notas"])), section("## Taxas (BRL)", doc["taxas"], fee), section("## Prazos típicos (meses)", doc["prazo_meses_tipico"], term),
    )
    keys = F.coalesce(F.map_keys(doc["taxas"]), F.array().cast("array<string>"))
    parsed = sheets.select("slug", F.from_json("payload", SHEET).alias("doc")).where("doc.cidade is not null and doc.uf is not null")
    return parsed.select("slug", F.concat(F.lit("taxas-"), name).alias("chunk_id"), F.trim(F.regexp_replace(text, r"\s+\z", "")).alias("text"), "doc.cidade", "doc.uf", keys.alias("fee_keys"))


def gym_listings(gyms: DataFrame, labels: dict[str, str], ranks: dict[str, int], default: str = "Academia") -> DataFrame:
    """A chunk with its text, the text to embed and its metadata for each gym with an id.

    gyms (id, name, address, cities array, activity_id, plans array, least_plan, warning, slug). Long
    warnings are cut; labels and ranks are dictionaries of activities and plans.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    cities = F.coalesce(F.filter("cities", lambda x: F.trim(x) != ""), F.array().cast("array<string>"))
    plans = distinct_plans(F.coalesce("plans", F.array().cast("array<string>")), F.col("least_plan"))
    held = gyms.where("coalesce(id, '') <> ''").select(
        "id", F.coalesce(blank("name"), F.lit("Academia sem nome")).alias("nome"), F.coalesce(blank("address"), F.lit("Endereço não informado")).alias("endereco"), cities.alias("municipios"),
        label_of(F.nullif("activity_id", F.lit("")), labels, default).alias("modalidade"), plans.alias("planos"), ellipsis(blank("warning")).alias("warning"), blank("slug").alias("source_ref"),
    )
    listed = lambda c, none: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit(none))
    label = lambda name, x: F.concat(F.lit(name), x)
    text = F.concat_ws(
        "\n", label("Academia: ", F.col("nome")), label("Endereço: ", F.col("endereco")), label("Municípios Atendidos: ", listed("municipios", "N/D")), label("Modalidade Principal: ", F.col("modalidade")),
        label("Planos TotalPass Aceitos: ", listed("planos", "N/D")), label("Observação: ", F.col("warning")),
    )
    embedded = F.concat(
        F.lit("A "), F.col("nome"), F.lit(", localizada em "), F.col("endereco"), F.lit(", atende os municípios de "), listed("municipios", "município não informado"), F.lit(". Sua modalidade principal é "), F.col("modalidade"),
        F.lit(" e aceita os planos TotalPass: "), listed("planos", "planos não informados"), F.lit("."), F.coalesce(F.concat(F.lit(" Observação: "), F.col("warning"), F.lit(".")), F.lit("")),
    )
    return held.select(
        F.sha2("id", 256).alias("chunk_id"), F.lit("gym_listing").alias("chunk_type"), text.alias("text"), embedded.alias("embedding_content"), F.col("id").alias("gym_id"), "modalidade", slug(F.col("modalidade"), "_").alias("modalidade_key"),
        F.get("planos", F.lit(0)).alias("plano_minimo"), least_rank(F.col("planos"), ranks).alias("plano_minimo_rank"), "source_ref",
    )


def normal_gyms(docs: DataFrame, city: str = "Fortaleza", state: str = "CE") -> DataFrame:
    """Gym records of payloads (payload) that list them as items or academias, whatever their fields are called; the payload's own city is the default."""
    gym = "name string, nome string, address string, endereco string, bairro string, cidade string, uf string, modalidades array<string>, plano_minimo string, plan_minimo string, creditos_minimos double, creditos_por_dia double, valor_mensal_brl double, distancia_km double, partner_url string, url string"
    one = f"struct<{gym.replace(' string', ':string').replace(' array', ':array').replace(' double', ':double')}>"
    doc = F.from_json("payload", f"items array<{one}>, academias array<{one}>, cidade string, uf string")
    listed = docs.select(doc.alias("d")).select(F.posexplode(F.coalesce("d.items", "d.academias")).alias("ord", "g"), F.col("d.cidade").alias("city"), F.col("d.uf").alias("state"))
    g = lambda *names: filled(*[F.col(f"g.{n}") for n in names])
    plan = g("plano_minimo", "plan_minimo")
    return listed.select(
        "ord", g("name", "nome").alias("name"), g("address", "endereco").alias("address"), F.coalesce(g("bairro"), district_before(F.coalesce(g("address", "endereco"), F.lit("")))).alias("bairro"),
        F.coalesce(g("cidade"), filled(F.col("city")), F.lit(city)).alias("cidade"), F.upper(F.coalesce(g("uf"), filled(F.col("state")), F.lit(state))).alias("uf"), F.coalesce("g.modalidades", F.array().cast("array<string>")).alias("modalidades"),
        plan.alias("plano_minimo"), credits_of(F.coalesce("g.creditos_minimos", "g.creditos_por_dia"), plan).cast("double").alias("creditos_minimos"), "g.valor_mensal_brl", "g.distancia_km", g("partner_url", "url").alias("partner_url"),
    )


def sources(hits: DataFrame) -> DataFrame:
    """(chunk_id, score, nome_academia, municipios, modalidade, plano_minimo, warning, source_ref) of hits (chunk_id, score, source_ref, meta JSON)."""
    m = F.from_json("meta", "nome_academia string, cidade string, municipios_relacionados array<string>, modalidade string, plano_minimo string, planos_aceitos array<string>, warning_message string, source_ref string")
    held = hits.select("chunk_id", "score", F.col("source_ref").alias("own_ref"), m.alias("m"))
    trimmed = lambda c: F.nullif(F.trim(F.col(f"m.{c}")), F.lit(""))
    cities = F.array_distinct(F.filter(F.concat(F.array(trimmed("cidade")), F.coalesce("m.municipios_relacionados", F.array().cast("array<string>"))), lambda x: x.isNotNull() & (F.trim(x) != "")))
    return held.select(
        "chunk_id", "score", trimmed("nome_academia").alias("nome_academia"), cities.alias("municipios"), trimmed("modalidade").alias("modalidade"),
        F.coalesce(trimmed("plano_minimo"), F.get("m.planos_aceitos", F.lit(0))).alias("plano_minimo"), trimmed("warning_message").alias("warning"), F.coalesce(trimmed("source_ref"), "own_ref").alias("source_ref"),
    )


def missing_plans(chunks: DataFrame) -> DataFrame:
    """(group_id, missing) of chunks (group_id, chunk_type, meta JSON): groups that have gym chunks of which none states a plan, credits or price. Groups that have partner or law chunks as well are exempt."""
    m = F.from_json("meta", "plano_minimo string, creditos_minimos double, valor_mensal_brl double")
    states = F.coalesce(m["plano_minimo"], m["creditos_minimos"].cast("string"), m["valor_mensal_brl"].cast("string")).isNotNull()
    gym, other = F.col("chunk_type") == "gp_gym", F.col("chunk_type").isin("tp_partner", "law_chunk")
    found = chunks.groupBy("group_id").agg(F.count_if(gym).alias("gyms"), F.count_if(gym & states).alias("stated"), F.count_if(other).alias("others"))
    return found.select("group_id", ((F.col("gyms") > 0) & (F.col("stated") == 0) & (F.col("others") == 0)).alias("missing"))
