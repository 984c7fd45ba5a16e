"""Portuguese stop words and stems, by the published Snowball rules.

A word's stem hangs on regions of it: R1 begins after the first consonant that follows a vowel, R2
is R1 of R1, and RV is where endings of verbs are looked for. Words are lower case.
"""

from __future__ import annotations

from functools import lru_cache

VOWELS = set("aeiouáéíóúâêô")
#: The stop words of the published list.
STOP = frozenset(
    """de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já eu também só pelo pela até
    isso ela entre depois sem mesmo aos seus quem nas me esse eles você essa num nem suas meu às minha numa pelos elas qual nós lhe deles essas esses pelas este dele
    tu te vocês vos lhes meus minhas teu tua teus tuas nosso nossa nossos nossas dela delas esta estes estas aquele aquela aqueles aquelas isto aquilo
    estou está estamos estão estive esteve estivemos estiveram estava estávamos estavam estivera estivéramos esteja estejamos estejam estivesse estivéssemos estivessem estiver estivermos estiverem
    hei há havemos hão houve houvemos houveram houvera houvéramos haja hajamos hajam houvesse houvéssemos houvessem houver houvermos houverem houverei houverá houveremos houverão houveria houveríamos houveriam
    sou somos são era éramos eram fui foi fomos foram fora fôramos seja sejamos sejam fosse fôssemos fossem for formos forem serei será seremos serão seria seríamos seriam
    tenho tem temos tém tinha tínhamos tinham tive teve tivemos tiveram tivera tivéramos tenha tenhamos tenham tivesse tivéssemos tivessem tiver tivermos tiverem terei terá teremos terão teria teríamos teriam""".split()
)
#: Endings of the first step with what replaces them, and those of verbs; nasal vowels are written with a tilde behind.
PLAIN = "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância".split()
REPLACED = {"logia": "log", "logias": "log", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente"}
LONGER = {"amente": [("iv", "at"), ("os", None), ("ic", None), ("ad", None)], "mente": [("ante", None), ("avel", None), ("ível", None)], "idade": [("abil", None), ("ic", None), ("iv", None)], "idades": [("abil", None), ("ic", None), ("iv", None)], "iva": [("at", None)], "ivo": [("at", None)], "ivas": [("at", None)], "ivos": [("at", None)]}
VERBS = sorted(
    """ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem
    ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis
    íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos
    ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras""".split(),
    key=len,
    reverse=True,
)
FIRST = sorted([*PLAIN, *REPLACED, *LONGER, "ira", "iras"], key=len, reverse=True)


def _after(word: str, start: int) -> int:
    """The place after the first consonant that follows a vowel, from start on; the word's end if there is none."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _verbs_from(word: str) -> int:
    vowel = [c in VOWELS for c in word]
    if len(word) < 2:
        return len(word)
    if not vowel[1]:
        return next((i + 1 for i in range(2, len(word)) if vowel[i]), len(word))
    if vowel[0]:
        return next((i + 1 for i in range(2, len(word)) if not vowel[i]), len(word))
    return min(3, len(word))


@lru_cache(200_000)
def stem(word: str) -> str:
    w = word.replace("ã", "a~").replace("õ", "o~")
    r1 = _after(w, 0)
    r2, rv = (_after(w, r1) if r1 < len(w) else len(w)), _verbs_from(w)

    def first(w: str) -> str:
        end = next((x for x in FIRST if w.endswith(x)), None)
        if end is None:
            return w
        at = len(w) - len(end)
        if end in ("ira", "iras"):
            return w[:at] + "ir" if at >= rv and w[:at].endswith("e") else w
        if end in REPLACED:
            return w[:at] + REPLACED[end] if at >= r2 else w
        if at < (r1 if end == "amente" else r2):
            return w
        w = w[:at]
        for more, further in LONGER.get(end, ()):
            if w.endswith(more):
                if len(w) - len(more) >= r2:
                    w = w[: -len(more)]
                    if further and w.endswith(further) and len(w) - len(further) >= r2:
                        w = w[: -len(further)]
                break
        return w

    out = first(w)
    if out == w:
        end = next((x for x in VERBS if w.endswith(x) and len(w) - len(x) >= rv), None)
        out = w[: -len(end)] if end else w
    if out != w:
        if out.endswith("ci") and len(out) > rv:
            out = out[:-1]
    elif (end := next((x for x in ("os", "a", "i", "o", "á", "í", "ó") if out.endswith(x)), None)) and len(out) - len(end) >= rv:
        out = out[: -len(end)]
    if out[-1:] in ("e", "é", "ê") and len(out) > rv:
        out = out[:-1]
        if (out.endswith("gu") or out.endswith("ci")) and len(out) > rv:
            out = out[:-1]
    elif out.endswith("ç"):
        out = out[:-1] + "c"
    return out.replace("a~", "ã").replace("o~", "õ")
