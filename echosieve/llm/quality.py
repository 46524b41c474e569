"""Quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer.

Two faults are told apart, ``junk`` and ``toxic``.  For each, heuristic labellers vote yes, no or
nothing on every document: on its shape (capitals, symbols, bars, repeats, few distinct words),
or on words that are typical of labelled rows (two word lists from disjoint halves and one of
word beginnings).  Known labels are one more labeller, silent on most rows.  Over the counts of
vote patterns of all documents, expectation-maximisation estimates every labeller's hits and
false alarms and so the posterior of each pattern.  The posteriors of a bounded sample of
labelled rows (``SAMPLE_ROWS``) train one logistic scorer per fault on hashed words, hashed word
beginnings and shapes, as shares of the text.  A document is kept when no scorer passes 1/2.

Whole texts are read twice: for the votes and for the scores.  To the driver come only vote
patterns (at most 3 ** labellers), word lists (``LIST_SIZE``) and the sample's listed features.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echosieve.llm.common import let, may_broadcast
from echosieve.operators.survivors import unused
from echosieve.workspace import Workspace

BUCKETS = 1 << 18
PREFIX = 5
SAMPLE_ROWS = 20_000
LIST_SIZE = 2000
SUPPORT, ODDS = 3, 10.0
SMOOTH = 50.0  # words added to a text's length, so that one word of a short text is no share
SHARE = 0.008  # share of listed words from which a list votes yes
SHAPES = ("caps", "symbols", "bars", "repeats", "alike")
#: Shares of words from which the shape labellers vote yes.
SHAPE_LIMITS = {"caps": 0.3, "symbols": 0.3, "bars": 0.15, "repeats": 0.3, "alike": 0.7}
LISTS = ("list_a", "list_b", "list_prefix")
YES, NO, SILENT = 2, 1, 0
FAULTS = ["junk", "toxic"]
KNOWN_RATES = (0.98, 0.001)  # hits and false alarms of the known labels
SCALE = 100.0  # of the hashed features, shares of a text
THRESHOLD = 0.5
BROADCAST_BYTES = 16 << 20
SLAB = 1 << 18  # list entries summed at a time


def features(text: Column) -> Column:
    """Struct of hashed words and beginnings, the number of words, and the shape counts."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")

    def of(t: Column) -> Column:
        # One pattern for all words of a text: they hold no blank, so the pieces are theirs in
        # order.  A text without words has one empty piece, which counts for nothing.
        bare = F.regexp_replace(F.lower(F.array_join(t, " ")), r"[^\p{L} ]+", "")
        return let(F.split(bare, " "), lambda w: let(
            F.transform(F.filter(w, lambda x: x != ""), lambda x: _bucket(x)), lambda words: F.struct(
                words.alias("words"),
                F.transform(
                    F.filter(w, lambda x: F.length(x) > PREFIX),
                    lambda x: _bucket(F.left(x, F.lit(PREFIX)), F.lit("beginning")),
                ).alias("prefixes"),
                F.size(t).alias("n"),
                F.size(F.filter(t, lambda x: (F.length(x) > 2) & (F.upper(x) == x)
                                & (F.lower(x) != x))).alias("caps"),
                F.size(F.filter(
                    F.zip_with(t, w, lambda x, y: F.length(x) - F.length(y) > 1), lambda x: x
                )).alias("symbols"),
                F.size(F.filter(t, lambda x: x == "|")).alias("bars"),
                F.size(F.filter(t, lambda x, i: (i > 0) & (
                    x == t[F.greatest(i - 1, F.lit(0))]))).alias("repeats"),
                (F.size(words) - F.size(F.array_distinct(words))).alias("alike"),
            )
        ))

    return let(tokens, of)


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def _sums(lists, table):
    """For each row of a list column, the sum of ``table`` over its entries.

    Worked off in slabs of rows, so that memory stays near that of the column itself.
    """
    import numpy as np

    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)
    out = np.zeros(len(lists))
    row = 0
    while row < len(lists):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLAB, "right")) - 1)
        values = table[flat[offsets[row]:offsets[last]]]
        running = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
        ends = offsets[row:last + 1] - offsets[row]
        out[row:last] = running[ends[1:]] - running[ends[:-1]]
        row = last
    return out


def _shares(batch):
    """Shape shares of a struct array, a column each."""
    import numpy as np

    n = batch.field("n").to_numpy() + 0.0
    return np.stack([batch.field(s).to_numpy() / np.maximum(n, 1.0) for s in SHAPES], axis=1), n


def _with_features(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` plus the features of ``text``.

    Spark can't take an expression with lambda variables as an argument of a Python function, and
    moves a column's expression there when it can; it moves nothing through a generator.
    """
    return docs.select("*", F.explode(F.array(features(F.col(text)))).alias(out))


def _votes(lists: dict[str, list[int]]):
    """Arrow function: the vote pattern of every document, junk and toxic, in base 3."""

    @F.arrow_udf("struct<junk: int, toxic: int>")
    def vote(batch):
        import numpy as np
        import pyarrow as pa

        shares, n = _shares(batch)
        limits = np.array([SHAPE_LIMITS[s] for s in SHAPES])
        shape = np.where(shares >= limits, YES, NO)
        shape[n < 10, SHAPES.index("alike")] = SILENT
        junk = shape @ 3 ** np.arange(len(SHAPES))
        toxic = np.zeros(len(batch), np.int64)
        for k, name in enumerate(LISTS):
            table = np.zeros(BUCKETS, np.float32)
            table[lists[name]] = 1
            column = batch.field("prefixes" if name == "list_prefix" else "words")
            yes = _sums(column, table) / (n + SMOOTH) >= SHARE
            toxic += np.where(yes, YES, NO) * 3**k
        return pa.StructArray.from_arrays(
            [pa.array(junk, pa.int32()), pa.array(toxic, pa.int32())], ["junk", "toxic"]
        )

    return vote


def expectation_maximisation(votes, counts, rounds: int = 200):
    """Posterior of every pattern and the labellers' rates ``(share, hits, false alarms)``.

    ``votes``: patterns x labellers of ``YES``, ``NO``, ``SILENT``; ``counts``: documents per
    pattern.  Labellers are taken as independent given the truth.  The last one is the known
    labels: its rates are given (``KNOWN_RATES``), which also tells the two classes apart.
    """
    import numpy as np

    votes, counts = np.asarray(votes), np.asarray(counts, float)
    yes, no = votes == YES, votes == NO
    share, hits = 0.1, np.full(votes.shape[1], 0.6)
    alarms = np.full(votes.shape[1], 0.02)
    hits[-1], alarms[-1] = KNOWN_RATES
    for _ in range(rounds):
        good = np.log1p(-share) + yes @ np.log(alarms) + no @ np.log1p(-alarms)
        bad = np.log(share) + yes @ np.log(hits) + no @ np.log1p(-hits)
        posterior = 1 / (1 + np.exp(np.clip(good - bad, -500, 500)))
        weight_bad, weight_good = counts * posterior, counts * (1 - posterior)
        share = (weight_bad.sum() + 1) / (counts.sum() + 10)
        hits[:-1] = ((weight_bad @ yes + 2) / (weight_bad @ (yes | no) + 4))[:-1]
        alarms[:-1] = ((weight_good @ yes + 1) / (weight_good @ (yes | no) + 200))[:-1]
    return posterior, (share, hits, alarms)


def _digits(code: int, n: int) -> list[int]:
    return [code // 3**k % 3 for k in range(n)]


def fit_scorer(entries, shapes, targets, width: int, decay: float = 1e-5, rounds: int = 400):
    """``(weights, shape weights, bias)`` of a logistic scorer with soft targets (Adam).

    ``entries``: arrays (row, feature below ``width``, value) of the hashed features; ``shapes``:
    a dense row per document.
    """
    import numpy as np

    row, feature, value = entries
    rows, dense = len(targets), shapes.shape[1]
    w = np.zeros(width + dense + 1)
    w[-1] = -2.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        z = np.bincount(row, w[feature] * value, rows) + shapes @ w[width:-1] + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - targets) / max(rows, 1)
        grad = np.concatenate([
            np.bincount(feature, error[row] * value, width), error @ shapes, [error.sum()]
        ])
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w[:width], w[width:-1], w[-1]


class Model:
    """Word lists, the label model's rates, and a linear scorer for each fault."""

    def __init__(self, lists: dict, rates: dict, heads: dict):
        self.lists, self.rates, self.heads = lists, rates, heads

    def score(self, docs: DataFrame, text: str, out: str) -> DataFrame:
        """``docs`` plus ``out``: struct of the probabilities ``junk`` and ``toxic``."""
        words, prefixes, heads = *_columns(self.lists), self.heads

        @F.arrow_udf("struct<junk: double, toxic: double>")
        def scores(batch):
            import numpy as np
            import pyarrow as pa

            shares, n = _shares(batch)
            out = []
            for fault in FAULTS:
                weights, shape, bias = heads[fault]
                z = shares @ shape + bias
                for column, ids, own in (
                    ("words", words, weights[:len(words)]),
                    ("prefixes", prefixes, weights[len(words):]),
                ):
                    table = np.zeros(BUCKETS)
                    table[ids] = own
                    z += _sums(batch.field(column), table) * SCALE / (n + SMOOTH)
                out.append(pa.array(np.where(n == 0, 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))))
            return pa.StructArray.from_arrays(out, FAULTS)

        held = unused("_f", docs)
        return _with_features(docs, text, held).withColumn(out, scores(held)).drop(held)


def _columns(lists: dict) -> tuple[list[int], list[int]]:
    """The listed words and the listed beginnings, in the order of the weights."""
    return sorted({*lists["list_a"], *lists["list_b"]}), sorted(lists["list_prefix"])


def _word_lists(sample: DataFrame) -> dict[str, list[int]]:
    """Hashed words and beginnings that are typical of toxic labelled rows."""
    half = F.when(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(2)) == 0, "list_a").otherwise("list_b")
    toxic = F.col("toxic").cast("double")
    one = sample.filter("toxic is not null").select(
        half.alias("list"), toxic.alias("toxic"), F.array_distinct("f.words").alias("ids")
    ).unionAll(sample.filter("toxic is not null").select(
        F.lit("list_prefix"), toxic, F.array_distinct("f.prefixes")
    ))
    sums = one.groupBy("list").agg(
        F.sum("toxic").alias("all_toxic"), F.sum(1 - F.col("toxic")).alias("all_clean")
    )
    ratio = (
        (F.col("in_toxic") + 0.5) / (F.col("all_toxic") + 1)
        / ((F.col("in_clean") + 0.5) / (F.col("all_clean") + 1))
    )
    found = (
        one.select("list", "toxic", F.explode("ids").alias("id"))
        .groupBy("list", "id")
        .agg(F.sum("toxic").alias("in_toxic"), F.sum(1 - F.col("toxic")).alias("in_clean"))
        .filter(F.col("in_toxic") >= SUPPORT)
        .join(F.broadcast(sums), "list")  # one row a list
        .filter(ratio >= ODDS)
        .orderBy(F.desc("in_toxic"), "id").limit(LIST_SIZE * len(LISTS))
        .collect()
    )
    return {name: [r["id"] for r in found if r["list"] == name] for name in LISTS}


def _listed(lists: dict):
    """Arrow function: which listed features a document holds, and how often."""
    words, prefixes = _columns(lists)

    @F.arrow_udf("struct<at: array<int>, times: array<int>>")
    def listed(batch):
        import numpy as np
        import pyarrow as pa

        found = []
        for column, ids, shift in (("words", words, 0), ("prefixes", prefixes, len(words))):
            table = np.full(BUCKETS, -1, np.int32)
            table[ids] = np.arange(len(ids)) + shift
            found.append([table[x.values.to_numpy()] for x in batch.field(column)])
        at, times = [], []
        for a, b in zip(*found):
            both = np.concatenate([a, b])
            which, count = np.unique(both[both >= 0], return_counts=True)
            at.append(which)
            times.append(count)
        kind = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(at, kind), pa.array(times, kind)], ["at", "times"])

    return listed


def fit(
    docs: DataFrame, labels: DataFrame, work: Workspace, doc_id: str = "doc_id",
    text: str = "text", sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Label model over all of ``docs``, scorers on at most about ``sample_rows`` labelled rows.

    ``labels`` has ``quality`` (0: junk) and ``toxic`` (1: toxic) for some ids; nulls are silent,
    repeated ids count once (the worse label).  Without any labels or documents the scorers rest
    on what votes there are, and keep everything if there are none.
    """
    import numpy as np

    known = work.table(labels.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(
        F.max(1 - F.col("quality")).cast("int").alias("junk"), F.max("toxic").cast("int").alias("toxic")
    ).filter("doc_id is not null"), "labels")
    share = min(1.0, sample_rows / max(known.count(), 1))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sample = work.table(
        texts.join(may_broadcast(chosen, 24, BROADCAST_BYTES), "doc_id")
        .select("doc_id", "junk", "toxic", features(F.col("text")).alias("f")),
        "sample",
    )
    lists = _word_lists(sample)
    vote = _votes(lists)
    votes = work.table(
        _with_features(texts, "text", "f").select("doc_id", vote("f").alias("v"))
        .select("doc_id", "v.*"),
        "votes",
    ).toDF("doc_id", "p_junk", "p_toxic")
    known_votes = votes.join(known, "doc_id", "left")
    posteriors, rates = {}, {}
    for fault, labellers in (("junk", len(SHAPES)), ("toxic", len(LISTS))):
        label = F.when(F.col(fault) == 1, YES).when(F.col(fault) == 0, NO).otherwise(SILENT)
        counted = known_votes.groupBy(f"p_{fault}", label.alias("label")).count().collect()
        patterns = [[*_digits(r[0], labellers), r[1]] for r in counted]
        if patterns:
            posterior, rates[fault] = expectation_maximisation(patterns, [r[2] for r in counted])
            posteriors[fault] = {(r[0], r[1]): p for r, p in zip(counted, posterior)}
    listed = _listed(lists)
    rows = sample.select(
        vote("f").alias("v"), "junk", "toxic", listed("f").alias("l"), F.col("f.n").alias("n"),
        *[F.col(f"f.{s}").alias(s) for s in SHAPES],
    ).collect()
    if not rows:
        heads = {f: (np.zeros(sum(map(len, _columns(lists)))), np.zeros(len(SHAPES)), -2.0)
                 for f in FAULTS}
        return Model(lists, rates, heads)
    width = sum(map(len, _columns(lists)))
    row = np.repeat(np.arange(len(rows)), [len(r["l"]["at"]) for r in rows])
    at = np.array([a for r in rows for a in r["l"]["at"]], np.int64)
    times = np.array([t for r in rows for t in r["l"]["times"]], float)
    n = np.array([r["n"] for r in rows], float)
    shapes = np.array([[r[s] for s in SHAPES] for r in rows], float) / np.maximum(n, 1)[:, None]
    heads = {}
    for fault in FAULTS:
        code = {1: YES, 0: NO, None: SILENT}
        targets = np.array([posteriors[fault][r["v"][fault], code[r[fault]]] for r in rows])
        value = times * SCALE / (n[row] + SMOOTH)
        heads[fault] = fit_scorer((row, at, value), shapes, targets, width)
    return Model(lists, rates, heads)


def classify(
    docs: DataFrame, labels: DataFrame, work: Workspace, doc_id: str = "doc_id",
    text: str = "text", sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``docs`` plus ``junk_score``, ``toxic_score`` and ``accepted`` (replaced if there).

    A text without words, null or empty, scores 0 and is accepted.  All rows stay, repeated ones
    and null ids too.
    """
    model = fit(docs, labels, work, doc_id, text, sample_rows)
    score = unused("_score", docs)
    junk, toxic = F.col(score)["junk"], F.col(score)["toxic"]
    return model.score(docs, text, score).withColumns({
        "junk_score": junk, "toxic_score": toxic,
        "accepted": (junk < THRESHOLD) & (toxic < THRESHOLD),
    }).drop(score)
