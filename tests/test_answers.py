"""Answers to tables of questions against a loop over the rules, lists included."""

import re

import pytest

from tessera.operators import answers, render

GYMS = [
    (1, "A", "Centro", "Ilimitado 35", None, 173.25), (2, "B", None, "Ilimitado 20", 15, None), (3, "Crossfit Aldeota", "Aldeota", "Ilimitado 60", None, 297.0), (4, "D", "Coco Norte", None, 70, 99.5),
    (5, "E", "", None, None, None), (6, "F", "Cocó", "Livre", None, 99.5), (7, "crossfit aldeota 2", "coco", "Ilimitado 10", 10, 10.0),
]
QUESTIONS = ["Qual o valor do plano Ilimitado 35?", "preço do ilimitado 22", "valor das academias ilimitado 35", "tem no Cocó?", "coco com 10 créditos", "coco com 1 credito", "mais barata", "a mais barata com 12 créditos", "menor preço com 2 creditos", "crossfit aldeota", "crossfit aldeota com 20 créditos", "crossfit aldeota ilimitado 99", "lista", "quais com 35 créditos", "Ilimitado 3", "oi", "", None, "QUANTO CUSTA ilimitado 100000000000"]


def plain(x):
    return str(int(x)) if x == int(x) else repr(x)


def said(g):
    return f"• {g[1]} ({g[2] or '?'}) — {g[3] or '?'} / R${'?' if g[5] is None else plain(g[5])}"


def by_rules(question, gyms):
    q = (question or "").lower()
    m = re.search(r"ilimitado\s*(\d+)", q) or re.search(r"(\d+)\s*cr[eé]ditos?", q)
    credits = int(m[1]) if m and int(m[1]) < 2**31 else None
    need = lambda g: g[4] if g[4] is not None else (int(n[0]) if (n := re.search(r"\d+", g[3] or "")) else None)
    listed = [g for g in gyms if any(x is not None for x in g[3:6])]
    if not gyms:
        return "Agente publicado sem academias indexadas. Rode Treinar & Publicar (seed Fortaleza)."
    if re.search("valor|pre[cç]o|custa|quanto", q) and credits is not None and not re.search("academ|aceit|lista|quais", q):
        seen = next((g for g in listed if need(g) == credits), None)
        price = seen[5] if seen and seen[5] is not None else round(credits * 4.95, 2)
        return f"Ilimitado {credits} = R${price:.2f}/mês" + (f" (visto em {seen[1]})" if seen else " (tabela R$4,95/crédito)") + "."
    fits = [g for g in listed if credits is None or (need(g) is not None and need(g) <= credits)]
    if re.search("coco|cocó", q):
        near = [g for g in fits if "coco" in (g[2] or "").lower()]
        return "\n".join(map(said, near)) or "Nenhuma academia indexada com bairro Cocó neste agente. Snapshot atual é Fortaleza city-wide."
    if re.search("barat|menor pre", q):
        best = min(fits, key=lambda g: (9e9 if g[5] is None else g[5], g[0]), default=None)
        return f"Mais barata no filtro{'' if credits is None else f' (≤{credits} créditos)'}:\n{said(best)}" if best else "Nenhuma academia no filtro do seu plano."
    if "crossfit aldeota" in q:
        one = next((g for g in gyms if "crossfit aldeota" in g[1].lower()), None)
        if one is None:
            return "Crossfit Aldeota não está no índice."
        if credits is not None and credits < (70 if need(one) is None else need(one)):
            return f"Crossfit Aldeota exige {one[3]} (R${plain(one[5])}). Seu plano ({credits} créditos) NÃO cobre."
        return said(one)
    if credits is not None or re.search("quais|lista|aceit|gurupass|academ", q):
        header = f"Gurupass indexado: {len(fits)} academias" if credits is None else f"Gurupass com ≤{credits} créditos: {len(fits)}/{len(listed)} academias"
        return header + "\n" + ("\n".join(map(said, fits)) or "(nenhuma no filtro)")
    return "Pergunte: lista Gurupass, bairro, plano (ex. Ilimitado 35), ou academia específica."


def rendered(found, lines):
    """Each question's whole answer: its text and the lines that follow."""
    held = {}
    for x in lines.orderBy("kind", "limit_key", "place").collect():
        held.setdefault((x["kind"], x["limit_key"]), []).append(x["line"])
    return {x["question_id"]: "\n".join(([x["text"]] if x["text"] else []) + (held[x["kind"], x["limit_key"]] if x["kind"] else [])) for x in found.collect()}


@pytest.mark.parametrize("gyms", [GYMS, GYMS[:2], []])
def test_gym_answers(spark, gyms):
    table = spark.createDataFrame(gyms, "ord long, name string, bairro string, plano_minimo string, creditos_minimos int, valor_mensal_brl double").repartition(3)
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id long, question string")
    got = rendered(*answers.answer_gyms(asked, table))
    assert got == {i: by_rules(q, gyms) for i, q in enumerate(QUESTIONS)}


def test_gyms_without_plans_and_hint(spark):
    table = spark.createDataFrame([(1, "A", None, None, None, None)], "ord long, name string, bairro string, plano_minimo string, creditos_minimos int, valor_mensal_brl double")
    asked = spark.createDataFrame([(1, "lista"), (2, "lista")], "question_id long, question string")
    found, lines = answers.answer_gyms(asked, table)
    assert {(x["intent"], x["kind"], x["limit_key"]) for x in found.collect()} == {("no_plans", "names", "all")} and [tuple(x) for x in lines.collect()] == [("names", "all", 1, "A")]
    assert answers.answer_gyms(asked.limit(0), table)[0].count() == 0


def test_partner_answers(spark):
    rows = [(1, "A", None, "TP 3", 99.9), (2, "Coco Fit", None, "TP 5", 49.0), (3, "C", "Coco", "TP GO", None), (4, "D", None, None, 1.0), (5, "", None, "TP 1", 1.0), (6, "E", "Centro", "TP 1", 20.0)]
    table = spark.createDataFrame(rows, "ord long, name string, bairro string, plan_minimo string, price_brl_month double")
    questions = ["lista", "TP 3", "cocó", "TP 1 no coco", "TP free no coco", "TP free", "mais barata", "tp go mais barata", "preço", "oi", "total  pass"]
    asked = spark.createDataFrame(list(enumerate(questions)), "question_id long, question string")
    a, b, c, e = "• A — TP 3 / R$99.9", "• Coco Fit — TP 5 / R$49", "• C (Coco) — TP GO / R$?", "• E (Centro) — TP 1 / R$20"
    want = [
        "\n".join(["TotalPass indexado: 4 academias", a, b, c, e]), "\n".join(["TotalPass com ≤TP 3: 3/5", a, c, e]), "\n".join([b, c]), c, "TotalPass (fixture Cocó / partners): 0 academias com ≤TP Free", "TotalPass com ≤TP Free: 0/5\n(nenhuma)",
        "Mais barata no filtro:\n" + e, "Mais barata no filtro:\n" + c, "tabela", "tabela", "\n".join(["TotalPass indexado: 4 academias", a, b, c, e]),
    ]
    assert rendered(*answers.answer_partners(asked, table, "tabela")) == dict(enumerate(want))
    bare = rendered(*answers.answer_partners(asked.where("question_id >= 8"), table))
    assert bare[8] == bare[9] == "Pergunte: lista TotalPass, TP3, Cocó, ou preço tabela."
    assert "Sem partners" in rendered(*answers.answer_partners(asked, table.limit(0)))[0]


HIT = "query_id int, ord int, gym_id string, nome string, bairro string, modalidade string, plano string, plan_rank int, valor string, horario string, score double"


def test_rendered_hits(spark):
    hits = [
        (1, 0, "z", "Zulu", None, "boxe", "Silver", 2, "R$ 50", None, 0.9), (1, 1, "a", "Ácqua", "Centro", "natacao", "Gold", 3, "N/A", "6h às 22h", 0.8), (1, 2, "b", "acqua fit", "", "Natacao", None, None, None, "", 0.7),
        (1, 3, "a", "Ácqua", "Centro", "natacao", "Basic", 1, None, None, 0.8), (1, 4, "z", "Zulu Yoga", None, "boxe", "Silver", 2, "R$ 70", None, 0.95), (1, 5, "s", "Sol", None, "surf_e_sol", "Silver", 4, None, None, None),
    ]
    searches = spark.createDataFrame([(1, " Recife "), (2, None)], "query_id int, municipio string")
    got = {x["query_id"]: x["text"] for x in render.answers(searches, spark.createDataFrame(hits, HIT).repartition(3)).collect()}
    assert got[1].split("\n") == [
        "Academias em Recife que aceitam Wellhub (resultados recuperados):", "", "Total: 4 academia(s) única(s) nos resultados recuperados.", "Por plano mínimo Wellhub:", "Basic: 1 academia(s)", "Silver: 2 academia(s) (valor referência: R$ 50)", "Plano não informado: 1 academia(s)", "",
        "Yoga", "Zulu Yoga — Silver", "", "Boxe", "Zulu — Silver", "", "Natação", "Ácqua (Centro) — Gold | Horário: 6h às 22h", "acqua fit — Plano não informado", "", "Surf E Sol", "Sol — Silver",
    ]
    assert got[2] == render.NOTHING
