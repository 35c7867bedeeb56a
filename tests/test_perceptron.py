import random

import pytest

from textloom.operators import perceptron


def plain(docs: list[tuple[list[str], str]]) -> tuple[dict, int]:
    """The rule with all sums kept as lists: what each weight counted at every error so far."""
    weights, counted, seen, n = {}, {}, {}, 0
    for terms, label in docs:
        seen[label] = seen.get(label, 0) + 1
        mean = lambda k: sum(counted[k] + [weights[k]] * (n - len(counted[k]))) / max(1, n)  # noqa: B023, E731
        known = {c for c, _ in weights}
        score = {c: round(sum(mean((c, t)) for t in terms if (c, t) in weights), 9) for c in known}
        if not known:
            guess = min(seen, key=lambda c: (-seen[c], c))
        else:
            guess = min((c for c in score if score[c] == max(score.values())), key=lambda c: (seen.get(c, 0), c))
        if guess != label:
            n += 1
            for c, step in ((label, 1), (guess, -1)):
                for t in terms:
                    weights[c, t] = weights.get((c, t), 0) + step
                    # a new value counts for all errors since the last change
                    old = counted.get((c, t), [])
                    counted[c, t] = old + [weights[c, t]] * (n - len(old))
    return {k: sum(counted[k] + [w] * (n - len(counted[k]))) / max(1, n) for k, w in weights.items()}, n


@pytest.fixture(scope="module")
def docs():
    dice = random.Random(2)
    out = []
    for i in range(90):
        label = dice.choice("abc")
        terms = {f"{label}{dice.randint(0, 4)}" for _ in range(3)} | {f"x{dice.randint(0, 9)}" for _ in range(3)}
        out.append((i, label, sorted(terms)))
    return out


def frames(spark, docs):
    v = spark.createDataFrame([(i, t, 1.0) for i, _, terms in docs for t in terms], "doc_id long, term string, w double")
    return v, spark.createDataFrame([(i, label) for i, label, _ in docs], "doc_id long, label string")


def test_one_shard_is_the_online_rule(spark, docs):
    v, labels = frames(spark, docs)
    m = perceptron.AveragedPerceptron(epochs=3, shards=1).train(v, labels)
    order = [x for e in range(3) for x in sorted(docs, key=lambda d: (perceptron._scatter(d[0], e), d[0]))]
    want, errors = plain([(terms, label) for _, label, terms in order])
    got = {(r.label, r.term): r.w for r in m.weights.collect()}
    assert m.errors == errors > 5
    assert {k: round(w, 9) for k, w in got.items() if abs(w) > 1e-9} == {k: round(w, 9) for k, w in want.items() if abs(w) > 1e-9}


def test_shards_mix_to_the_mean_of_all_updates(spark, docs):
    v, labels = frames(spark, docs)
    m = perceptron.AveragedPerceptron(epochs=2, shards=3).train(v, labels)
    shard = {r.doc_id: r.s for r in labels.selectExpr("doc_id", "pmod(xxhash64(doc_id), 3) AS s").collect()}
    state, total, errors, seen = {}, {}, 0, {}
    for epoch in range(2):
        ends = []
        for s in range(3):
            rule = perceptron.Online(errors)
            rule.seen = dict(seen)
            for (c, t), w in state.items():
                rule.weights.setdefault(c, {})[t] = [w, total[c, t], errors]
            for i, label, terms in sorted((d for d in docs if shard[d[0]] == s), key=lambda d: (perceptron._scatter(d[0], epoch), d[0])):
                rule.learn(terms, label)
            ends.append((rule.errors - errors, {(c, t): (w, x) for c, t, w, x in rule.totals()}, rule.seen))
        keys = {k for _, e, _ in ends for k in e}
        new = {k: sum(e.get(k, (state.get(k, 0.0), 0))[0] for _, e, _ in ends) / 3 for k in keys}
        total = {k: total.get(k, 0.0) + sum((e[k][1] - total.get(k, 0.0)) if k in e else n * state.get(k, 0.0) for n, e, _ in ends) for k in keys}
        state, errors = new, errors + sum(n for n, _, _ in ends)
        seen = {c: seen.get(c, 0) + sum(x.get(c, 0) - seen.get(c, 0) for _, _, x in ends) for c in "abc"}
    got = {(r.label, r.term): r.w for r in m.weights.collect()}
    assert m.errors == errors and m.seen == seen
    assert {k: round(w, 9) for k, w in got.items() if abs(w) > 1e-9} == {k: round(w / errors, 9) for k, w in total.items() if abs(w) > 1e-9}


def test_it_learns_and_has_defined_results(spark, docs):
    v, labels = frames(spark, docs)
    m = perceptron.AveragedPerceptron(epochs=4, per_shard=30).train(v, labels)
    right = m.predict(v).join(labels, "doc_id").where("label = predicted").count()
    assert right > 80
    new = spark.createDataFrame([(1, "nowhere"), (2, None)], "doc_id long, term string")
    p = m.classify(new).collect()
    assert len(p) == 6 and all(abs(r.p - 1 / 3) < 1e-9 for r in p)
    rare = min(m.seen, key=lambda c: (m.seen[c], c))
    assert {r.predicted for r in m.predict(new).collect()} == {rare}
    same = perceptron.AveragedPerceptron().train(v, labels.selectExpr("doc_id", "'only' AS label"))
    assert {r.predicted for r in same.predict(v).collect()} == {"only"}
