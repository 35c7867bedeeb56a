import random
import tracemalloc

import pyarrow as pa

from textloom.llm import decontaminate
from textloom.llm.words import words_of


def shingles(text: str, width: int = 5) -> set[tuple]:
    w = text.lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def found(docs: list[str], items: list[str], once: bool = False):
    index = decontaminate._build(pa.array(range(len(items))), pa.array(items), 5, 75)
    return decontaminate._search(words_of(pa.array(docs)), index, 75, once)


def test_templates_take_bounded_memory():
    dice = random.Random(1)
    template = " ".join(f"instruction{i}" for i in range(20))
    items = [template + " " + " ".join(f"q{dice.randrange(10**9)}" for _ in range(15)) for _ in range(8000)]
    docs = [template + f" and then document {i}" for i in range(800)] + [items[5], "before " + items[7] + " after"]
    index = decontaminate._build(pa.array(range(len(items))), pa.array(items), 5, 75)
    tracemalloc.start()
    d, i, shared = decontaminate._search(words_of(pa.array(docs)), index, 75)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(d.tolist(), i.tolist(), strict=True)) == [(800, 5), (801, 7)] and most < 100e6


def test_items_that_are_nearly_all_template_are_all_found():
    template = " ".join(f"t{i}" for i in range(30))
    items = [f"{template} u{i}" for i in range(700)]
    docs = [template] * 1500 + ["t1 t2 t3 t4 t5"]
    d, i, shared = found(docs, items)
    assert len(d) == 700 * 1500 and set(shared.tolist()) == {26} and len(set(zip(d.tolist(), i.tolist(), strict=True))) == len(d)
    d, *_ = found(docs, items, once=True)
    assert d.tolist() == list(range(1500))


def test_equals_brute_force_with_shared_shingles(monkeypatch):
    monkeypatch.setattr(decontaminate, "_PAIRS", 50)  # many chunks
    dice = random.Random(3)
    words = [f"w{i}" for i in range(6)]
    text = lambda n: " ".join(dice.choices(words, k=n))
    for _ in range(20):
        blocks = [text(9) for _ in range(4)]
        items = [dice.choice(blocks) + " " + text(dice.randint(0, 6)) for _ in range(25)] + ["w1", "w1 w2 w3", ""]
        docs = [" ".join([text(dice.randint(0, 9)), *dice.choices(blocks, k=dice.randint(0, 3)), dice.choice(items)]) for _ in range(30)] + ["", "w1"]
        want = set()
        for a, x in enumerate(docs):
            for b, y in enumerate(items):
                n = len(y.split())
                have, need = shingles(x, min(5, max(1, n))) if len(x.split()) >= min(5, max(1, n)) else set(), shingles(y)
                if need and 100 * len(need & have) >= 75 * len(need):
                    want.add((a, b, len(need & have)))
        d, i, s = found(docs, items)
        assert set(zip(d.tolist(), i.tolist(), s.tolist(), strict=True)) == want
        assert set(found(docs, items, once=True)[0].tolist()) == {a for a, *_ in want}
