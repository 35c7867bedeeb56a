"""Inflection of five languages on regular and irregular words."""

import pytest

from textloom.operators import inflect_eu as eu

PAIRS = {
    "de": [("katze", "katzen"), ("lehrerin", "lehrerinnen"), ("zeitung", "zeitungen"), ("haus", "häuser"), ("auto", "autos"), ("mädchen", "mädchen")],
    "es": [("gato", "gatos"), ("luz", "luces"), ("canción", "canciones"), ("papel", "papeles")],
    "fr": [("chat", "chats"), ("bateau", "bateaux"), ("cheval", "chevaux"), ("œil", "yeux")],
    "it": [("gatto", "gatti"), ("amica", "amiche"), ("nazione", "nazioni"), ("uomo", "uomini"), ("città", "città")],
    "nl": [("kat", "katten"), ("boom", "bomen"), ("meisje", "meisjes"), ("huis", "huizen"), ("kind", "kinderen"), ("vrijheid", "vrijheden")],
}


@pytest.mark.parametrize("language", eu.LANGUAGES)
def test_number(language):
    for single, many in PAIRS[language]:
        assert eu.pluralize(single, language) == many
        assert eu.singularize(many, language) == single


def test_adjectives_and_gender():
    assert [eu.gender(w, "de") for w in ("Zeitung", "Mädchen", "Lehrer")] == ["f", "n", "m"]
    assert [eu.gender(w, "it") for w in ("nazione", "gatto", "amica")] == ["f", "m", "f"]
    assert eu.predicative("neugierige", "de") == "neugierig" and eu.predicative("horribles", "es") == "horrible" and eu.predicative("rojas", "es") == "rojo"
    assert eu.predicative("heureuse", "fr") == "heureux" and eu.predicative("rossa", "it") == "rosso" and eu.predicative("grote", "nl") == "groot"
    assert eu.attributive("neugierig", "de", "f") == "neugierige" and eu.attributive("groot", "nl") == "grote" and eu.attributive("rojo", "es", "f", True) == "rojas"


def test_verbs():
    assert [eu.lemma(w, "de") for w in ("bin", "spielst", "gespielt", "spielte")] == ["sein", "spielen", "spielen", "spielen"]
    assert [eu.lemma(w, "es") for w in ("soy", "hablas", "hablando", "vivieron")] == ["ser", "hablar", "hablar", "vivir"]
    assert [eu.lemma(w, "fr") for w in ("suis", "parlons", "finissez")] == ["être", "parler", "finir"]
    assert [eu.lemma(w, "it") for w in ("sono", "parlando", "creduto", "dormito")] == ["essere", "parlare", "credere", "dormire"]
    assert [eu.lemma(w, "nl") for w in ("ben", "gewerkt", "werkte")] == ["zijn", "werken", "werken"]
    assert "hablamos" in eu.lexeme("hablar", "es") and "gespielt" in eu.lexeme("spielen", "de") and "gewerkt" in eu.lexeme("werken", "nl")


def test_tags():
    assert eu.penn("N(soort,ev,neut)", "wotan") == "NN" and eu.penn("NCMS000", "parole") == "NN" and eu.penn("VMN0000", "parole") == "VB"
