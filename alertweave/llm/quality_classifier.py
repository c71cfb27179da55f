"""Quality classifier: evidence of a document, combined with what its host and its path have shown.

1. Evidence. A logistic regression on hashed words (2**16 buckets) and text statistics is fitted on a bounded sample of
   labelled documents (``sample``, 20,000 by default). A document is good if its label says quality 1 and toxic 0.
   The model is a vector of fixed size; every document's log odds come from one pass over its whole text.
2. Posteriors. Each document counts as a Beta observation of its host and of its path within the host: its label where
   it has one, else its evidence probability, weighted by ``soft``. A host's good share is shrunk towards the global
   share, a path's towards its host's; the strength of the shrinking is estimated from the spread of the shares
   (method of moments), so sparse sites stay near their prior. Both are grouped aggregations over all documents.
3. Toxicity has a vector of its own, fitted on toxic labels alone in four fifths of the sample. A document is toxic if its
   whole text or its worst passage (of ``PASSAGE`` words) reaches a bar; each of the two bars is set on the last fifth, where it
   may cost ``loss`` of the documents that are good.
4. Score. log odds = evidence + ``trust`` * (logit of the path posterior - logit of the global share). A document is
   kept if its probability is at least ``least`` and it is not toxic. Labels never enter a document's own evidence.

``documents`` has no address: its host is ``source`` and its path ``source/lang``; ``pages`` rows can be given host and
path columns by :func:`address`. A null host or path is a group of its own. A null text has no words. Without labels
of both kinds the evidence is 0 and everything is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave.llm.common import over_texts, packed_away, read, unpacked, words_of

BUCKETS = 1 << 16  # fits in two bytes
N_STATS = 6
SIZE = BUCKETS + N_STATS + 1
PASSAGE = 64


def address(docs: DataFrame, url: str = "url") -> DataFrame:
    """Host and path (all but the last part) of an address, as columns."""
    host = F.lower(F.regexp_extract(url, r"^\w+://([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^\w+://([^?#]*/)", 1)
    return docs.withColumns({"host": host, "path": F.when(path == "", host).otherwise(path)})


@dataclass
class Model:
    """Weights for good and for toxic, and from where on the whole text and the worst passage are toxic."""

    good: np.ndarray
    toxic: np.ndarray
    whole_bar: float = np.inf
    passage_bar: float = np.inf


def _words(texts: pa.Array) -> tuple:
    """The words of texts and the bucket of each distinct one."""
    words = words_of(pc.fill_null(texts, ""))
    bucket = np.fromiter(
        (xxhash.xxh3_64_intdigest(w) & (BUCKETS - 1) for w in pc.cast(words.distinct, pa.binary()).to_pylist()), np.int64
    )
    return words, bucket


def _passages(words, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the distinct words of each passage, where each passage begins in them, and where each text in the passages."""
    first = np.concatenate(([0], np.cumsum(-(-words.counts // PASSAGE)))).astype(np.int64)
    owner = words.owner()
    passage = first[owner] + (np.arange(len(owner)) - words.bounds[owner]) // PASSAGE
    pairs = np.unique(passage * BUCKETS + (bucket[words.codes] if len(bucket) else words.codes))
    return pairs % BUCKETS, np.searchsorted(pairs, np.arange(first[-1] + 1) * BUCKETS), first


def _features(texts: pa.Array, read: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the distinct words of each text, where each text begins in them, and its statistics."""
    texts = pc.fill_null(texts, "")
    words, bucket = read or _words(texts)
    pairs = np.unique(words.owner() * BUCKETS + (bucket[words.codes] if len(bucket) else words.codes))
    n, counts = len(texts), words.counts
    bounds = np.searchsorted(pairs, np.arange(n + 1) * BUCKETS)
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float)
    distinct = np.unique(words.owner() * (len(words.distinct) + 1) + words.codes)
    found = np.bincount(distinct // (len(words.distinct) + 1), minlength=n)
    per = np.maximum(chars, 1)
    stats = np.stack(
        [
            np.log1p(counts) / 8,
            chars / np.maximum(counts, 1) / 10,
            pc.count_substring_regex(texts, r"[#*$%&|<>!]").to_numpy(zero_copy_only=False) / per * 4,
            pc.count_substring_regex(texts, r"\p{Lu}").to_numpy(zero_copy_only=False) / per,
            found / np.maximum(counts, 1),
            pc.count_substring_regex(texts, r"\d").to_numpy(zero_copy_only=False) / per * 4,
        ],
        axis=1,
    )
    return pairs % BUCKETS, bounds, stats


def fit(
    at: np.ndarray, bounds: np.ndarray, stats: np.ndarray, good: np.ndarray, passes: int = 8, rate: float = 0.3, decay: float = 1e-5
) -> np.ndarray:
    """Weights of the buckets, the statistics and a constant, by AdaGrad over small groups of documents."""
    w, seen = np.zeros(SIZE), np.full(SIZE, 1e-3)
    if not len(good) or good.all() or not good.any():
        return w
    # A small sample is gone through more often.
    passes = max(passes, min(40, 10_000 // len(good)))
    rng = np.random.default_rng(11)
    for _ in range(passes):
        order = rng.permutation(len(good))
        for group in np.array_split(order, max(1, len(order) // 32)):
            n = bounds[group + 1] - bounds[group]
            own = np.repeat(np.arange(len(group)), n)
            where = at[np.repeat(bounds[group] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            scale = 1 / np.sqrt(np.maximum(n, 1))
            odds = scale * np.bincount(own, weights=w[where], minlength=len(group)) + stats[group] @ w[BUCKETS:-1] + w[-1]
            error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - good[group]
            slope = np.bincount(where, weights=(error * scale)[own], minlength=SIZE)
            slope[BUCKETS:-1] = error @ stats[group]
            slope[-1] = error.sum()
            slope = slope / len(group) + decay * w
            seen += slope * slope
            w -= rate * slope / np.sqrt(seen)
    return w


def _odds(at: np.ndarray, bounds: np.ndarray, stats: np.ndarray | None, w: np.ndarray) -> np.ndarray:
    n = np.diff(bounds)
    own = np.repeat(np.arange(len(n)), n)
    odds = np.bincount(own, weights=w[at], minlength=len(n)) / np.sqrt(np.maximum(n, 1)) + w[-1]
    return odds if stats is None else odds + stats @ w[BUCKETS:-1]


def _worst(odds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The greatest odds among the passages of each text."""
    worst = np.full(len(first) - 1, -np.inf)
    np.maximum.at(worst, np.repeat(np.arange(len(worst)), np.diff(first)), odds)
    return worst


def bar(odds: np.ndarray, toxic: np.ndarray, good: np.ndarray, loss: float) -> float:
    """From where on odds are toxic: where most toxic ones are reached at a ``loss`` of good ones, and no lower than that takes."""
    clean = np.sort(odds[good])[::-1]
    lost = int(loss * len(clean))
    reached = odds[toxic & (odds > clean[lost])] if len(clean) else odds[toxic]
    if not len(reached):
        return np.inf
    least = reached.min()
    below = odds[odds < least]
    return float((least + below.max()) / 2) if len(below) and np.isfinite(below.max()) else float(least)


def _verdicts(labels: DataFrame) -> DataFrame:
    """doc_id, good and toxic (1 or 0); of several labels the worst counts."""
    good = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)
    toxic = F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    told = labels.where("doc_id is not null and (quality is not null or toxic = 1)")
    return told.groupBy("doc_id").agg(F.min(good).alias("good"), toxic)


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, loss: float = 0.01) -> Model:
    """Fit on at most ``sample`` labelled documents, those with the least hash of their id."""
    known = _verdicts(labels)
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    rows = docs.select("doc_id", "text").join(known, "doc_id").select("text", "good", "toxic", F.xxhash64("doc_id", "text").alias("h"))

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text")
        words, bucket = _words(texts)
        at, bounds, stats = _features(texts, (words, bucket))
        lists = [at[a:b].astype("<u2").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        # Passages of the last fifth, for the bars.
        last = part.column("h").to_numpy() % 5 == 0
        inner, cuts, first = _passages(words, bucket)
        spans = list(zip(first[:-1], first[1:], last, strict=True))
        passages = [inner[cuts[a] : cuts[b]].astype("<u2").tobytes() if x else b"" for a, b, x in spans]
        sizes = [np.diff(cuts[a : b + 1]).astype("<u2").tobytes() if x else b"" for a, b, x in spans]
        arrays = [part.column(c) for c in ("h", "good", "toxic")]
        arrays += [pa.array(x, pa.binary()) for x in (lists, [x.tobytes() for x in stats], passages, sizes)]
        return pa.RecordBatch.from_arrays(arrays, names=["h", "good", "toxic", "at", "stats", "passages", "sizes"])

    # Features instead of texts go to the driver, some hundred bytes a document.
    schema = "h long, good int, toxic int, at binary, stats binary, passages binary, sizes binary"
    table = over_texts(rows, step, schema).orderBy("h").limit(sample).toArrow()

    def numbers(column: str) -> tuple[np.ndarray, np.ndarray]:
        parts = table.column(column).to_pylist()
        flat = np.frombuffer(b"".join(parts), dtype="<u2").astype(np.int32)
        return flat, np.concatenate(([0], np.cumsum([len(x) // 2 for x in parts]))).astype(np.int64)

    at, bounds = numbers("at")
    stats = np.frombuffer(b"".join(table.column("stats").to_pylist())).reshape(-1, N_STATS)
    good, toxic = (table.column(c).to_numpy() == 1 for c in ("good", "toxic"))
    last = table.column("h").to_numpy() % 5 == 0
    fitted = fit(at, bounds, stats, good.astype(float) == 1)
    begin = bounds[:-1][~last]
    n = np.diff(bounds)[~last]
    own_bounds = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
    own_at = at[np.repeat(begin - own_bounds[:-1], n) + np.arange(n.sum())]
    model = Model(fitted, fit(own_at, own_bounds, np.zeros((len(n), N_STATS)), toxic[~last]))
    if model.toxic.any():
        whole = _odds(at, bounds, None, model.toxic)[last]
        inner, _ = numbers("passages")
        sizes, first = numbers("sizes")
        worst = _worst(_odds(inner, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), None, model.toxic), first)[last]
        model.whole_bar, model.passage_bar = (bar(odds, toxic[last], good[last], loss) for odds in (whole, worst))
    return model


def with_evidence(docs: DataFrame, model: Model, toxic: bool = False) -> DataFrame:
    """``docs`` with its log odds of being good in ``evidence``, and whether it is ``toxic`` if asked for; such columns are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ["evidence", "toxic"] if toxic else ["evidence"]
    names = [c for c in docs.columns if c not in added]

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        model, texts = shared.value, part.column("text")
        words, bucket = _words(texts)
        at, bounds, stats = _features(texts, (words, bucket))
        arrays = [part.column(c) for c in names] + [pa.array(_odds(at, bounds, stats, model.good))]
        if toxic:
            found = _odds(at, bounds, None, model.toxic) >= model.whole_bar
            if np.isfinite(model.passage_bar):
                inner, cuts, first = _passages(words, bucket)
                found |= _worst(_odds(inner, cuts, None, model.toxic), first) >= model.passage_bar
            arrays.append(pa.array(found))
        return pa.RecordBatch.from_arrays(arrays, names=[*names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)
    return over_texts(docs.select(*names), step, f"{fields}, evidence double" + (", toxic boolean" if toxic else ""))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sure(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def posteriors(observed: DataFrame) -> DataFrame:
    """host, path, host_posterior, path_posterior and global_share from rows of host, path, weight and share.

    A path's strength and a host's are the numbers of observations that a prior counts for: mean (1 - mean) over the
    variance between groups beyond what sampling explains, kept from 2 to 1000.
    """
    paths = observed.groupBy("host", "path").agg(
        F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("share")).alias("good")
    )
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))

    def strength(groups: DataFrame, n: str, good: str, name: str) -> DataFrame:
        """One row: the overall share and the strength of its prior."""
        total = groups.agg(F.sum(n).alias("t"), F.sum(good).alias("g"), F.count("*").alias("k"))
        share = ((F.col("g") + 1) / (F.col("t") + 2)).alias("m")
        moments = groups.crossJoin(F.broadcast(total.select(share, "k", "t"))).agg(
            F.max("m").alias("m"),
            F.sum(F.col(n) * F.pow(F.col(good) / F.greatest(F.col(n), F.lit(1e-9)) - F.col("m"), 2)).alias("s"),
            F.max("k").alias("k"),
            F.max("t").alias("t"),
            F.sum(F.pow(F.col(n), 2)).alias("sq"),
        )
        within = F.col("m") * (1 - F.col("m"))
        room = F.greatest(F.col("t") - F.col("sq") / F.col("t"), F.lit(1e-9))
        between = F.greatest((F.col("s") - (F.col("k") - 1) * within) / room, F.lit(1e-9))
        return moments.select(
            F.col("m").alias("global_share"), F.least(F.greatest(within / between, F.lit(2.0)), F.lit(1000.0)).alias(name)
        )

    by_host = hosts.crossJoin(F.broadcast(strength(hosts, "host_n", "host_good", "host_strength")))
    by_host = by_host.withColumn(
        "host_posterior",
        (F.col("host_good") + F.col("host_strength") * F.col("global_share")) / (F.col("host_n") + F.col("host_strength")),
    )
    by_path = paths.withColumnRenamed("host", "h").join(by_host, F.col("h").eqNullSafe(F.col("host"))).drop("h")
    spread = strength(paths, "n", "good", "path_strength").drop("global_share")
    return by_path.crossJoin(F.broadcast(spread)).select(
        "host",
        "path",
        "global_share",
        "host_posterior",
        ((F.col("good") + F.col("path_strength") * F.col("host_posterior")) / (F.col("n") + F.col("path_strength"))).alias(
            "path_posterior"
        ),
    )


ADDED = ["evidence", "good", "host_posterior", "path_posterior", "probability", "toxic", "kept"]


def classified(
    docs: DataFrame,
    labels: DataFrame,
    host: Column | None = None,
    path: Column | None = None,
    sample: int = 20_000,
    soft: float = 0.5,
    trust: float = 0.5,
    least: float = 0.5,
    loss: float = 0.01,
) -> DataFrame:
    """``docs`` with host, path, evidence, toxic, host_posterior, path_posterior, probability and kept.

    Columns of these names are replaced. Aggregates are small next to the texts; what goes back to the rows is one
    line for each path, joined by Spark's choice of join.
    """
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.col("source"), F.col("lang")) if path is None else path
    whole = docs.withColumns({"host": host, "path": path}).drop(*ADDED)
    needs = ("doc_id", "text", "host", "path")
    base = packed_away(whole, *needs)
    model = train(base, labels, sample, loss)
    known = _verdicts(labels).drop("toxic")
    slim = with_evidence(base.select("doc_id", "host", "path", "text"), model).drop("text")
    seen = slim.join(known, "doc_id", "left")
    observed = seen.select(
        "host",
        "path",
        F.when(F.col("good").isNotNull(), 1.0).otherwise(F.lit(soft)).alias("weight"),
        F.coalesce(F.col("good").cast("double"), _sure(F.col("evidence"))).alias("share"),
    )
    sites = posteriors(observed).toDF("h", "p", "global_share", "host_posterior", "path_posterior")
    scored = with_evidence(base, model, toxic=True)
    out = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    odds = F.col("evidence") + trust * (_logit(F.col("path_posterior")) - _logit(F.col("global_share")))
    out = out.withColumn("probability", _sure(odds))
    # Without a model nothing speaks against a document.
    kept = F.col("probability") >= least if model.good.any() else F.lit(True)
    found = ["evidence", "toxic", "host_posterior", "path_posterior", "probability"]
    return out.select(*unpacked(whole, needs), *found, (kept & ~F.col("toxic")).alias("kept"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = classified(docs, read(spark, sf_dir, "labels"))
    return out.select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "probability", "toxic", "kept")
