from collections import Counter, defaultdict

import pytest

from textloom.operators.suffixtag import SuffixTagger

RUSSIAN = [("дом", "NN"), ("дома", "NN"), ("говорить", "VB"), ("ходить", "VB"), ("Ходить", "VB"), ("красный", "JJ"), ("новый", "JJ"), ("старый", "JJ"), ("быстро", "RB"), ("хорошо", "RB"), ("окно", "NN"), ("письмо", "NN"), ("говорит", "VB"), (None, "NN"), ("слово", None), ("печь", "NN"), ("печь", "VB")]
ENGLISH = [("walking", "VBG"), ("thing", "NN"), ("talking", "VBG"), ("king", "NN"), ("quickly", "RB"), ("slowly", "RB"), ("fly", "VB"), ("house", "NN"), ("houses", "NNS"), ("cats", "NNS"), ("is", "VBZ"), ("is", "VBZ")]


def brute(tagged, words, least):
    counts = Counter((w.lower(), t) for w, t in tagged if w and t)
    lexicon, found = defaultdict(dict), defaultdict(Counter)
    for (w, t), n in counts.items():
        lexicon[w][t] = n
        for k in range(len(w) + 1):
            found[w[len(w) - k :]][t] += 1
    best = lambda c: min(c, key=lambda t: (-c[t], t))
    out = {}
    for word in words:
        w = word.lower()
        if w in lexicon:
            out[word] = (best(lexicon[w]), "word")
            continue
        for k in range(len(w), -1, -1):
            e = w[len(w) - k :]
            if e in found and (sum(found[e].values()) >= least or not e):
                out[word] = (best(found[e]), e)
                break
    return out


@pytest.mark.parametrize("tagged", [RUSSIAN, ENGLISH])
@pytest.mark.parametrize("least", [1, 2, 3])
def test_equals_brute_force(spark, tagged, least):
    words = ["любить", "Зелёный", "дом", "село", "ПЕЧЬ", "jumping", "badly", "dogs", "xyz", "щщщ", ""]
    frame = spark.createDataFrame([(w, "x") for w in [*words, *words, None]], "token string, tag string")
    m = SuffixTagger(least=least).train(spark.createDataFrame(tagged, "word string, tag string"))
    rows = m.tag(frame, "token").collect()
    want = brute(tagged, words, least)
    assert len(rows) == 2 * len(words) + 1
    for r in rows:
        assert (r.tag, r.by) == want.get(r.token, (None, None)), r


def test_unknown_words_go_by_their_longest_ending(spark):
    m = SuffixTagger().train(spark.createDataFrame(RUSSIAN, "word string, tag string"))
    tags = {r.word: r.tag for r in m.tag(spark.createDataFrame([("носить",), ("зелёный",), ("плохо",)], "word string")).collect()}
    assert tags["носить"] == "VB" and tags["зелёный"] == "JJ"
    empty = SuffixTagger().train(spark.createDataFrame([], "word string, tag string"))
    assert [r.tag for r in empty.tag(spark.createDataFrame([("дом",)], "word string")).collect()] == [None]
