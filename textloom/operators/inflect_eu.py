"""Inflection of German, Spanish, French, Italian and Dutch by ending rules with small tables of irregular words.

Functions take the language's code; each table of rules is tried in order and the first that fits counts.
"""

from __future__ import annotations

import re

LANGUAGES = ("de", "es", "fr", "it", "nl")

#: Fixed irregular plurals of each language.
IRREGULAR = {
    "de": {"mann": "männer", "haus": "häuser", "buch": "bücher", "kind": "kinder", "mutter": "mütter", "vater": "väter", "apfel": "äpfel", "stadt": "städte", "hand": "hände", "maus": "mäuse", "land": "länder", "wort": "wörter"},
    "es": {"régimen": "regímenes", "carácter": "caracteres", "lunes": "lunes", "crisis": "crisis"},
    "fr": {"œil": "yeux", "monsieur": "messieurs", "madame": "mesdames", "bal": "bals", "festival": "festivals", "bijou": "bijoux", "caillou": "cailloux", "genou": "genoux", "travail": "travaux", "bleu": "bleus", "pneu": "pneus"},
    "it": {"uomo": "uomini", "dio": "dei", "uovo": "uova", "mano": "mani", "bue": "buoi", "ala": "ali", "città": "città", "re": "re"},
    "nl": {"kind": "kinderen", "ei": "eieren", "stad": "steden", "schip": "schepen", "lid": "leden", "weg": "wegen", "dag": "dagen", "glas": "glazen", "museum": "musea", "koe": "koeien"},
}
_PLURAL = {
    "de": [(r"(in)$", r"\1nen"), (r"(e)$", r"\1n"), (r"(ung|heit|keit|schaft|tät|ion)$", r"\1en"), (r"(el|er|en|chen|lein)$", r"\1"), (r"([aiouy])$", r"\1s"), (r"(nis)$", r"\1se"), (r"$", "e")],
    "es": [(r"z$", "ces"), (r"([aeo])$", r"\1s"), (r"á(n)$", r"a\1es"), (r"é([ns])$", r"e\1es"), (r"í([ns])$", r"i\1es"), (r"ó(n)$", r"o\1es"), (r"ú(n)$", r"u\1es"), (r"([^áéíóú]s|x)$", r"\1"), (r"([iuéáóíú])$", r"\1s"), (r"$", "es")],
    "fr": [(r"([sxz])$", r"\1"), (r"(eau|au|eu)$", r"\1x"), (r"al$", "aux"), (r"$", "s")],
    "it": [(r"([àèéìòù])$", r"\1"), (r"([^aeiou])$", r"\1"), (r"(c|g)a$", r"\1he"), (r"([aeiou][cg])ia$", r"\1ie"), (r"([cg])ia$", r"\1e"), (r"a$", "e"), (r"([aeiou]c)o$", r"\1i"), (r"(g|c)o$", r"\1hi"), (r"io$", "i"), (r"[oe]$", "i"), (r"$", "")],
    "nl": [(r"([aiouy])$", r"\1's"), (r"(je|tje|pje)$", r"\1s"), (r"(e|el|er|en|em|aar|eur|or|ie)$", r"\1s"), (r"(heid)$", "heden"), (r"([^aeiou])([aeiou])f$", r"\1\2ven"), (r"(aa|ee|oo|uu)([bcdfgklmnprstvz])$", lambda m: m[1][0] + {"f": "v", "s": "z"}.get(m[2], m[2]) + "en"), (r"(ij|ui|ou|oe|eu|ei|au|ie)s$", r"\1zen"), (r"(ij|ui|ou|oe|eu|ei|au|ie)f$", r"\1ven"), (r"(^|[^aeiou])([aeiou])([bdfgklmnpst])$", r"\1\2\3\3en"), (r"$", "en")],
}
_SINGULAR = {
    "de": [(r"(chen|lein)$", r"\1"), (r"innen$", "in"), (r"(ung|heit|keit|schaft|tät|ion)en$", r"\1"), (r"nisse$", "nis"), (r"([aiouy])s$", r"\1"), (r"(el|er)n$", r"\1"), (r"en$", "e"), (r"(chen|lein|er|el)$", r"\1"), (r"e$", "")],
    "es": [(r"ces$", "z"), (r"ones$", "ón"), (r"anes$", "án"), (r"ines$", "ín"), (r"eses$", "és"), (r"([lrdnj])es$", r"\1"), (r"([aeiou])s$", r"\1")],
    "fr": [(r"(?<!e)aux$", "al"), (r"(eau|au|eu)x$", r"\1"), (r"s$", "")],
    "it": [(r"([cg])he$", r"\1a"), (r"([cg])hi$", r"\1o"), (r"ie$", "ia"), (r"([aeiou]c)i$", r"\1o"), (r"e$", "a"), (r"(zion|sion|gion|tor|ment|mes|can|pan|fior|amor|color|dolor)i$", lambda m: m[1] + ("o" if m[1] == "ment" else "e")), (r"i$", "o")],
    "nl": [(r"'s$", ""), (r"heden$", "heid"), (r"(je|e|el|er|em|aar|eur|or|ie)s$", r"\1"), (r"(ij|ui|ou|oe|eu|ei|au|ie)zen$", r"\1s"), (r"(ij|ui|ou|oe|eu|ei|au|ie)ven$", r"\1f"), (r"([bdfgklmnprst])\1en$", r"\1"), (r"(^|[^aeiou])([aeou])([bcdgklmnprt])en$", r"\1\2\2\3"), (r"(^|[^aeiou])([aeou])zen$", r"\1\2\2s"), (r"(^|[^aeiou])([aeou])ven$", r"\1\2\2f"), (r"en$", "")],
}


def _apply(rules: list, word: str) -> str:
    for expression, to in rules:
        if re.search(expression, word):
            return re.sub(expression, to, word, count=1)
    return word


def _cased(out: str, word: str) -> str:
    return out[:1].upper() + out[1:] if word[:1].isupper() else out


def pluralize(word: str, language: str) -> str:
    w = word.lower()
    return _cased(IRREGULAR[language].get(w) or _apply(_PLURAL[language], w), word)


def singularize(word: str, language: str) -> str:
    w = word.lower()
    back = {v: k for k, v in IRREGULAR[language].items()}
    return _cased(back.get(w) or _apply(_SINGULAR[language], w), word)


def gender(word: str, language: str) -> str | None:
    """m, f or n of German and Italian nouns, by their endings; None where these don't tell."""
    rules = {
        "de": [(r"(?:ung|heit|keit|schaft|tät|ion|ei|ik|in|enz|anz|ur)$", "f"), (r"(?:chen|lein|ment|tum|um|ma)$", "n"), (r"(?:er|ling|ismus|or|ant|ist|ich|ig|en)$", "m"), (r"e$", "f")],
        "it": [(r"(?:zione|sione|gione|tà|tù|trice|ie|si|a)$", "f"), (r"(?:ma|ore|ale|ile|o|i|one)$", "m"), (r"e$", "m"), (r"[^aeiou]$", "m")],
    }[language]
    return next((g for p, g in rules if re.search(p, word.lower())), None)


def predicative(adjective: str, language: str) -> str:
    """The base form of an inflected adjective."""
    a = adjective.lower()
    if language == "de":
        return _apply([(r"(e[lr])e[nmrs]?$", r"\1"), (r"(.{2,})e[nmrs]?$", r"\1")], a)
    if language == "es":
        return _apply([(r"(dor|ón|és|án)as?$", r"\1"), (r"([ai]l|[aeiou][rz])es$", r"\1"), (r"as?$", "o"), (r"os$", "o"), (r"([e])s$", r"\1")], a)
    if language == "fr":
        return _apply([(r"(?:euses?)$", "eux"), (r"ives?$", "if"), (r"elles?$", "el"), (r"ennes?$", "en"), (r"onnes?$", "on"), (r"aux$", "al"), (r"ères?$", "er"), (r"ées?$", "é"), (r"ales?$", "al"), (r"([^aeiou]t|[aeiou][ndt]|is)es?$", r"\1"), (r"(e)s$", r"\1"), (r"s$", "")], a)
    if language == "it":
        return _apply([(r"([cg])h[ei]$", r"\1o"), (r"(ant|ent|il|al|ar|or|es)i$", r"\1e"), (r"[aei]$", "o") if not re.search(r"(?:nte|ile|ale|are|ore|ese)$", a) else (r"$", "")], a)
    return _apply([(r"([bdfgklmnprst])\1e$", r"\1"), (r"(ij|ui|ou|oe|eu|ei|au|ie)ze$", r"\1s"), (r"(ij|ui|ou|oe|eu|ei|au|ie)ve$", r"\1f"), (r"(^|[^aeiou])([aeou])([bcdgklmnprt])e$", r"\1\2\2\3"), (r"e$", "")], a)


def attributive(adjective: str, language: str, gender: str = "m", plural: bool = False, definite: bool = True) -> str:
    """The form before a noun; German gives the nominative."""
    a = adjective.lower()
    if language == "de":
        if plural:
            return a + ("en" if definite else "e")
        return a + ("e" if definite or gender == "f" else {"m": "er", "n": "es"}[gender])
    if language == "nl":
        if not definite and gender == "n" and not plural:
            return a
        return _apply([(r"e$", "e"), (r"(aa|ee|oo|uu)([bcdfgklmnprstvz])$", lambda m: m[1][0] + {"f": "v", "s": "z"}.get(m[2], m[2]) + "e"), (r"(ij|ui|ou|oe|eu|ei|au|ie)s$", r"\1ze"), (r"(^|[^aeiou])([aeiou])([bdfgklmnpst])$", r"\1\2\3\3e"), (r"$", "e")], a)
    if language == "fr":
        f = _apply([(r"e$", "e"), (r"eux$", "euse"), (r"if$", "ive"), (r"el$", "elle"), (r"en$", "enne"), (r"on$", "onne"), (r"er$", "ère"), (r"$", "e")], a) if gender == "f" else a
        return pluralize(f, "fr") if plural else f
    if gender == "f" and a.endswith("o"):
        a = a[:-1] + "a"
    return (pluralize(a, language) if plural else a) if language == "es" or plural else a


#: Fixed forms of frequent irregular verbs.
VERBS = {
    "de": {"sein": "bin bist ist sind seid war warst waren gewesen sei wäre", "haben": "habe hast hat habt hatte hatten gehabt hätte", "werden": "werde wirst wird wurde wurden geworden", "gehen": "ging gingen gegangen", "sehen": "siehst sieht sah sahen gesehen", "geben": "gibst gibt gab gaben gegeben"},
    "es": {"ser": "soy eres es somos sois son fui fue fueron era eran sido", "estar": "estoy estás está están estuvo", "haber": "he has ha hemos han había hubo", "ir": "voy vas va vamos van iba ido", "tener": "tengo tienes tiene tienen tuvo", "hacer": "hago haces hace hizo hecho"},
    "fr": {"être": "suis es est sommes êtes sont étais était étaient fut été sera", "avoir": "ai as a avons avez ont avait eu aura", "aller": "vais vas va allons allez vont ira", "faire": "fais fait faisons faites font fera"},
    "it": {"essere": "sono sei è siamo siete era erano fu stato sarà", "avere": "ho hai ha abbiamo avete hanno aveva avuto", "andare": "vado vai va vanno", "fare": "faccio fai fa facciamo fanno fatto"},
    "nl": {"zijn": "ben bent is was waren geweest", "hebben": "heb hebt heeft had hadden gehad", "gaan": "ga gaat ging gingen gegaan", "zien": "zie ziet zag zagen gezien"},
}
_LEMMA = {
    "de": [(r"^ge(.{2,})t$", r"\1en"), (r"(.{2,}[^e])test?$", r"\1en"), (r"(.{2,})ten$", r"\1en"), (r"(.{2,}[td])et(?:e|est|en)?$", r"\1en"), (r"(.{2,})en$", r"\1en"), (r"(.{2,}?)(?:est|st|te|t|e)$", r"\1en")],
    "es": [(r"(?:ando|ado|aba[sn]?|amos|áis|aron|aste|aré|ará[ns]?|as|an|a|o|é|ó)$", "ar"), (r"(?:iendo|ido|iste|ieron|imos|ís|ió|í)$", "ir"), (r"(?:emos|éis|es|en|e)$", "er")],
    "fr": [(r"(?:issons|issez|issent|issait|issant|it|is|i)$", "ir"), (r"(?:ant|ées?|és?|ons|ez|ent|ais|ait|aient|era|erai|eras|es|e)$", "er"), (r"(?:us?|ds|d)$", "dre")],
    "it": [(r"(?:endo|uto|eva|ete|ono)$", "ere"), (r"(?:ito|iva|ite|isce|ì)$", "ire"), (r"(?:ando|ato|ava|avano|iamo|ate|ano|arono|erà|o|i|a)$", "are"), (r"(?:e|é)$", "ere")],
    "nl": [(r"^ge(.{2,}?)[dt]$", r"\1en"), (r"(.{2,})[dt]en$", r"\1en"), (r"(.{2,}?)[td]e?$", r"\1en"), (r"(.{2,})en$", r"\1en"), (r"$", "en")],
}


def lemma(verb: str, language: str) -> str:
    """Infinitive of a verb form."""
    w = verb.lower()
    for infinitive, forms in VERBS[language].items():
        if w == infinitive or w in forms.split():
            return infinitive
    if re.search({"de": r"e[lr]?n$", "es": r"[aei]r$", "fr": r"(?:er|ir|re)$", "it": r"[aei]re$", "nl": r"^$"}[language], w):
        return w
    return _apply(_LEMMA[language], w)


def lexeme(verb: str, language: str) -> list[str]:
    """Infinitive and present, past and participle forms of a regular verb; the table's forms of an irregular one."""
    v = lemma(verb, language)
    if v in VERBS[language]:
        return [v, *VERBS[language][v].split()]
    if language == "de":
        s = re.sub("e?n$", "", v)
        e = "e" if re.search("[td]$", s) else ""
        return [v, s + "e", s + e + "st", s + e + "t", s + e + "te", s + e + "test", s + e + "ten", s + e + "tet", "ge" + s + e + "t", s + "end"]
    if language == "nl":
        s = _apply(_SINGULAR["nl"][5:], v)
        t = "t" if re.search("(?:t|k|f|s|ch|p|x)$", s) else "d"
        return [v, s, s if s.endswith("t") else s + "t", s + t + "e", s + t + "en", "ge" + s + ("" if s.endswith(t) else t)]
    s, kind = (v[:-2], v[-2:]) if language != "it" else (v[:-3], v[-3:])
    ends = {
        ("es", "ar"): "o as a amos áis an é aste ó aron ando ado", ("es", "er"): "o es e emos éis en í iste ió ieron iendo ido", ("es", "ir"): "o es e imos ís en í iste ió ieron iendo ido",
        ("fr", "er"): "e es e ons ez ent ais ait aient ant é era", ("fr", "ir"): "is is it issons issez issent issais issait issaient issant i ira", ("fr", "re"): "s s  ons ez ent ais ait aient ant u ra",
        ("it", "are"): "o i a iamo ate ano avo ava ando ato erà", ("it", "ere"): "o i e iamo ete ono evo eva endo uto erà", ("it", "ire"): "o i e iamo ite ono ivo iva endo ito irà",
    }.get((language, kind), "")
    return [v, *dict.fromkeys(s + e for e in ends.split(" ") if ends)]


#: Fixed map of Dutch corpus tags to Penn Treebank tags, by their beginning.
WOTAN = (("N(eigen", "NNP"), ("N(soort,mv", "NNS"), ("N(soort", "NN"), ("V(hulp", "MD"), ("V(inf", "VB"), ("V(tegdw", "VBG"), ("V(verldw", "VBN"), ("V(", "VBZ"), ("Adj(attr,vergr", "JJR"), ("Adj(attr,overtr", "JJS"), ("Adj", "JJ"), ("Adv", "RB"), ("Art", "DT"), ("Conj", "CC"), ("Int", "UH"), ("Misc", "FW"), ("Num", "CD"), ("Prep", "IN"), ("Pron", "PRP"), ("Punc(komma", ","), ("Punc", "."))
#: Fixed map of Parole tags of Romance corpora to Penn Treebank tags, by their beginning.
PAROLE = (("AO", "JJ"), ("AQ", "JJ"), ("CC", "CC"), ("CS", "IN"), ("DA", "DT"), ("DP", "PRP$"), ("D", "DT"), ("F", "."), ("I", "UH"), ("NCMP", "NNS"), ("NCFP", "NNS"), ("NC", "NN"), ("NP", "NNP"), ("P0", "PRP"), ("PP", "PRP"), ("PR", "WP"), ("P", "PRP"), ("RG", "RB"), ("RN", "RB"), ("SP", "IN"), ("VAN", "MD"), ("VMG", "VBG"), ("VMN", "VB"), ("VMP", "VBN"), ("VMIS", "VBD"), ("V", "VBP"), ("W", "CD"), ("Z", "CD"))


def penn(tag: str, kind: str) -> str:
    """The Penn Treebank tag of a ``wotan`` or ``parole`` tag; what isn't known stays."""
    return next((to for start, to in {"wotan": WOTAN, "parole": PAROLE}[kind] if tag.startswith(start)), tag)
