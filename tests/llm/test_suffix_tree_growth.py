"""The part of the suffix tree that grows with the corpus, against brute force."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alertweave.llm import suffix_tree_lm as lm

START, END = object(), None
SCHEMA = "doc_id long, text string"


def made(n, seed=3):
    """Each word depends on the three before it, now and then on none."""
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        words = ["a", "b", "c"]
        for _ in range(40):
            after = random.Random(" ".join(words[-3:])).choice("abcdefgh")
            words.append(after if r.random() < 0.8 else r.choice("abcdefghijklmnop"))
        texts.append(" ".join(words))
    return [*texts, "", None, "a b c unseen" + str(seed)]


def brute(train, model):
    """Contexts that are retained, with their rest and shares, and the probability of a word after a run."""
    s = model.settings
    texts = [[START, *(t or "").split(), END] for t in train]
    n = collections.Counter(tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, min(i + 9, len(t)) + 1))
    near = {}

    def symbol(w):
        if w in (START, END):
            return lm.END, 1.0
        t = lm._Tokens(pa.array([w]), s.endings)
        at, known = lm._found(model.hashes, t.hash)
        if known[0] and model.symbols[at[0]] >= 0:
            return int(model.symbols[at[0]]), 1.0
        symbol = int(t.ending[0]) + 1
        return symbol, (n[(w,)] + 0.5) / model.under[symbol]

    def p(context, w):
        pair = context[-1], w
        if pair not in near:
            code = symbol(context[-1])[0] * model.n_symbols + symbol(w)[0]
            near[pair] = float(lm._share(model, np.array([code]), len(model.levels))[0]) * symbol(w)[1]
        out = near[pair]
        for d in range(1, len(context) + 1):
            if context[-d:] in states:
                rest, own = states[context[-d:]]
                out = own.get(w, 0.0) + rest * out
            elif d > 1:
                break
        return out

    states, followers = {}, collections.defaultdict(dict)
    for run, k in n.items():
        if k >= s.follower_least and len(run) > 1:
            followers[run[:-1]][run[-1]] = k
    wanted = [c for c, k in n.items() if len(c) == 1 and k >= model.least() and c[0] is not END]
    while wanted:
        found = {}
        for c in wanted:
            before = {w: p(c, w) for w in followers[c]}
            own = {w: (k - s.discount) / n[c] for w, k in followers[c].items() if k * math.log(k / n[c] / before[w]) >= s.gain}
            rest = 1 - sum(own.values())
            away = sum(followers[c][w] / n[c] * math.log(o / before[w] + rest) for w, o in own.items())
            if own and away + (1 - sum(followers[c][w] for w in own) / n[c]) * math.log(rest) >= s.divergence:
                found[c] = rest, own
        looked, wanted = wanted, []
        states.update(found)
        several = {c for c in (looked if len(looked[0]) == 1 else found) if followers[c] and max(followers[c].values()) < n[c]}
        for c in looked:
            wanted += [(*c, w) for w, k in followers[c].items() if k >= model.least() and w is not END and (*c, w)[1:] in several]
    return states, p, max(map(len, states))


@pytest.mark.parametrize("count_share", [2e-6, 5e-3])
def test_tree_of_whole_words(spark, count_share):
    train, held = made(150), made(20, 4)
    df = spark.createDataFrame(list(enumerate(train)), SCHEMA).repartition(3).withColumn("held_out", F.lit(False))
    model, words = lm.fit(df, lm.Settings(count_share=count_share, context_least=5, context_share=1e-2))
    states, p, depth = brute(train, model)
    assert len(model.states) == depth >= 3
    kept = sum(1 + len(own) for _, own in states.values())
    assert sum(level.count() for level in model.states) == kept
    rows = spark.createDataFrame(list(enumerate(held)), SCHEMA).withColumn("held_out", F.lit(True))
    got = {r["doc_id"]: r["score"] for r in lm.scores(rows, model, words).collect()}
    for i, t in enumerate(held):
        run = (START, *(t or "").split(), END)
        want = sum(math.log10(p(run[max(0, k - depth) : k], run[k])) for k in range(1, len(run)))
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_more_text_gives_more_and_longer_contexts(spark):
    sizes = []
    for n in (60, 600):
        df = spark.createDataFrame(list(enumerate(made(n))), SCHEMA).withColumn("held_out", F.lit(False))
        model, _ = lm.fit(df, lm.Settings(context_least=20, context_share=1.0))
        sizes.append([level.count() for level in model.states])
    assert len(sizes[1]) > len(sizes[0]) and sum(sizes[1]) > 2 * sum(sizes[0])


def test_turns_bound_what_is_shuffled_at_once_and_change_nothing(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["of the", "in a", "b c d", f"w{r.randint(0, 60)}", f"x{r.randint(0, 4000)}"]) for _ in range(r.randint(0, 60))), i % 5 == 1) for i in range(600)]
    docs = spark.createDataFrame([*rows, (None, None, True), (7, "of the", True)], "doc_id long, text string, held_out boolean").repartition(6)
    written = lm._written

    def result(turn_tokens):
        labels = []
        monkeypatch.setattr(lm, "TURN_TOKENS", turn_tokens)
        monkeypatch.setattr(lm, "_written", lambda df, label: labels.append(label) or written(df, label))
        model, words = lm.counted(docs.where("not held_out"))
        codes = lm.coded(docs, model)
        lm.grow(codes.where("not held_out"), model, words)
        found = [tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in lm.scored(codes, model, words).collect()]
        return sorted(found, key=repr), labels

    one, labels = result(1 << 40)
    assert labels.count("sums") == 1 and "run-counts-1" not in labels
    turns, labels = result(100)
    assert labels.count("sums") == lm.RANGES and labels.count("run-counts-1") == lm.PASSES
    assert turns == one and len(one) == 602 and len({row[-1] for row in one}) > 500
