"""Quality rules: text statistics, and a decision list learned from labelled ones.

Statistics need one pass over the texts and no shuffle. The list is grown on a bounded sample of labelled rows
(``sample`` rows with the least hash of their id, 20,000 by default) by sequential covering: a rule is a conjunction of
thresholds, grown by information gain on two thirds of the sample, pruned on the rest, and kept while it is right
often enough; the rows it covers are then taken out. The ordered rules become one Spark conditional expression.

A null text has no words. A document with fewer than 10 words, or with more than a fifth of its words in repeated
5-word windows, fails the base test whatever the list says. Without labels of both kinds the list is empty and keeps
everything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave.llm.common import Runs, over_texts, read, starts_of, words_of

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines", "n_distinct"]
#: Shares that rules may test, each a count over another.
SHARES = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "words_per_line": ("n_words", "n_lines"),
    "distinct_share": ("n_distinct", "n_words"),
}
FEATURES = ["n_words", *SHARES]


def _repeat_words(codes: np.ndarray, bounds: np.ndarray, hashes: np.ndarray, window: int = 5) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it."""
    n = len(bounds) - 1
    start, owner = starts_of(bounds, window)
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    if len(start):
        runs = Runs(hashes)(start, start + window) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(runs, kind="stable")
        same = runs[order][1:] == runs[order][:-1]
        twice = np.zeros(len(start), dtype=bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        np.add.at(edge, start[twice], 1)
        np.add.at(edge, start[twice] + window, -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    return inside[bounds[1:]] - inside[bounds[:-1]] if n else np.zeros(0, np.int64)


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and how many of them equal an earlier line, for each text."""
    lists = pc.split_pattern(texts, "\n")
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    worded = pc.not_equal(pc.ascii_trim_whitespace(flat), "").to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)[worded].astype(np.int64)
    owner = owner[worded]
    distinct = np.unique(owner * (coded.max(initial=0) + 1) + coded)
    total = np.bincount(owner, minlength=len(texts))
    return total, total - np.bincount(distinct // (coded.max(initial=0) + 1), minlength=len(texts))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of COUNTS added; columns of the same names are replaced."""
    names = [c for c in docs.columns if c not in COUNTS]

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(part.column("text"), "")
        words = words_of(texts)
        one, _ = words.hashes()
        n = part.num_rows
        owner = words.owner()
        lengths = pc.utf8_length(words.distinct).to_numpy(zero_copy_only=False)[words.codes]
        pairs = np.unique(owner * (len(words.distinct) + 1) + words.codes)
        lines, dup = _lines(texts)
        found = {
            "n_words": words.counts,
            "word_chars": np.bincount(owner, weights=lengths, minlength=n),
            "n_symbols": pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy(zero_copy_only=False),
            "n_dup_lines": dup,
            "n_repeat_words": _repeat_words(words.codes, words.bounds, one),
            "n_upper": pc.count_substring_regex(texts, r"[A-Z]").to_numpy(zero_copy_only=False),
            "n_lines": lines,
            "n_distinct": np.bincount(pairs // (len(words.distinct) + 1), minlength=n),
        }
        arrays = [part.column(c) for c in names] + [pa.array(np.asarray(found[c]).astype(np.int64)) for c in COUNTS]
        return pa.RecordBatch.from_arrays(arrays, names=[*names, *COUNTS])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names]
    return over_texts(docs.select(*names), step, ", ".join(fields + [f"{c} long" for c in COUNTS]))


def feature(name: str) -> Column:
    """A feature of a row with statistics; a share of nothing is 0."""
    if name not in SHARES:
        return F.col(name).cast("double")
    over, under = (F.col(c).cast("double") for c in SHARES[name])
    return F.when(under > 0, over / under).otherwise(0.0)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    value: float

    def rows(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.value if self.above else x[self.feature] <= self.value

    def column(self) -> Column:
        return feature(self.feature) > self.value if self.above else feature(self.feature) <= self.value


@dataclass(frozen=True)
class Rule:
    """Reject where all tests hold."""

    tests: tuple[Test, ...]

    def rows(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([t.rows(x) for t in self.tests])

    def column(self) -> Column:
        out = self.tests[0].column()
        for t in self.tests[1:]:
            out = out & t.column()
        return out

    def __str__(self) -> str:
        return " and ".join(f"{t.feature} {'>' if t.above else '<='} {t.value:.6g}" for t in self.tests)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> tuple[Test, ...]:
    """Add the threshold of most information gain until only bad rows are covered."""
    tests: list[Test] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(tests) < most and (~bad[inside]).any() and bad[inside].any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best: tuple[float, Test | None] = (1e-9, None)
        for name, values in x.items():
            v = values[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], bad[inside][order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            low_p, low_n = np.cumsum(b)[cut], np.cumsum(~b)[cut]
            for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                gain = p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0)))
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), Test(name, above, float((v[cut[i]] + v[cut[i] + 1]) / 2)))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= best[1].rows(x)
    return tuple(tests)


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    covered = rule.rows(x)
    p = int((covered & bad).sum())
    n = int(covered.sum()) - p
    return ((p - n) / (p + n) if p + n else -1.0), p


def learn_rules(
    x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, most_tests: int = 4, least: int = 3, most_rules: int = 16
) -> list[Rule]:
    """Sequential covering of the bad rows; a rule must be right for ``precision`` of what it covers, held-out rows too."""
    side = np.random.default_rng(7).permutation(len(bad)) % 3
    grow, prune = side != 2, side == 2
    rules: list[Rule] = []
    while len(rules) < most_rules and bad[grow].any() and not bad[grow].all():
        tests = _grow({k: v[grow] for k, v in x.items()}, bad[grow], most_tests)
        if not tests:
            break
        held = {k: v[prune] for k, v in x.items()}
        choices = [Rule(tests[:i]) for i in range(len(tests), 0, -1)]
        rule = max(choices, key=lambda r: (*_worth(r, held, bad[prune]), -len(r.tests)))
        covered = rule.rows(x)
        right = (covered & bad).sum()
        sound = right >= least and right >= precision * covered.sum()
        if not sound or _worth(rule, held, bad[prune])[0] < 2 * precision - 1 and (covered & prune).any():
            break
        rules.append(rule)
        x = {k: v[~covered] for k, v in x.items()}
        grow, prune, bad = grow[~covered], prune[~covered], bad[~covered]
    return rules


def labelled(stats: DataFrame, labels: DataFrame, sample: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features and verdicts of at most ``sample`` labelled rows, those with the least hash of their id."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = (
        stats.join(good, "doc_id")
        .select(*[feature(f).alias(f) for f in FEATURES], "quality", F.xxhash64("doc_id").alias("h"))
        .orderBy("h")
        .limit(sample)
        .toPandas()
    )
    return {f: rows[f].to_numpy(float) for f in FEATURES}, (rows["quality"] == 0).to_numpy()


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Labelled documents for the fit: about ``sample`` of them, chosen by a hash before any text is looked at."""
    known = labels.where("doc_id is not null and quality is not null").select("doc_id").distinct()
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * 1.2 * sample / n))
    return docs.select("doc_id", "text").join(known, "doc_id", "left_semi")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """``docs`` with COUNTS, base_failed, rule (number of the first rule that fires, from 1) and kept."""
    x, bad = labelled(with_statistics(training_rows(docs, labels, sample)), labels, sample)
    rules = learn_rules(x, bad)
    fired = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        fired = F.when(rule.column(), F.lit(i)).otherwise(fired)
    names = [c for c in docs.columns if c not in ("base_failed", "rule", "kept")]
    out = with_statistics(docs.select(*names)).withColumns({"base_failed": base_failed(), "rule": fired})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", "rule")
