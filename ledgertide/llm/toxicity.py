"""Toxicity: maximum-scoring segments over token log-odds with Dirichlet priors, calibrated by extreme-value statistics.

1. Tokens are runs of letters and digits, ASCII lower-cased, hashed to 2^18 codes, so tables sent to executors have a
   fixed size. Documents with each code are counted in both classes over a bounded sample of labelled rows.
2. A code's log-odds has an informative Dirichlet prior (the pooled frequencies) and a standard error. Codes that are
   surely over-represented score their shrunk log-odds; every other token costs a small constant.
3. All maximal-scoring segments of a text come from one linear scan (after Ruzzo and Tompa): passages whose score
   no longer or shorter neighbour improves.
4. Under the clean class segment scores have an exponential tail (Karlin and Altschul): lambda solves
   E[exp(lambda * s)] = 1, K follows from the segments seen in clean texts. A passage's evidence is
   lambda * S - ln(K * tokens); a document's is its strongest passage's and the number of significant ones.
5. Texts scored by the counts of other texts turn evidence into a probability by logistic regression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.llm.common import forget, held_out, least_hashes, range_hashes, spans_of, text_buffer, written

CODES, PARTS = 1 << 18, 4
PER_CLASS = 12_000
PRIOR, SURE, LEAST, DRIFT = 0.2, 3.0, 4, 0.05
SHARE = 0.1  # of toxic texts, where no labels say otherwise
MOST = 30.0  # evidence beyond this (in nats) makes no further difference
CHUNK = 1 << 20
_CHAR = np.zeros(256, bool)
_CHAR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, ends, n + 1 token offsets by text) of texts laid end to end."""
    inside = _CHAR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    names = range_hashes(_LOWER[data], start, end)
    return (names >> np.uint64(46)).astype(np.int64), start, end, np.searchsorted(start, offsets)


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score) of a sequence, in linear time.

    Only positive entries can open a segment; what lies between two of them enters through the running sum.
    """
    total = np.concatenate(([0.0], np.cumsum(score)))
    open_: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum after
    for i in np.flatnonzero(score > 0).tolist():
        first, end, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            k = len(open_) - 1
            while k >= 0 and open_[k][2] >= left:
                k -= 1
            if k < 0 or open_[k][3] >= right:
                break
            first, left = open_[k][0], open_[k][2]
            del open_[k:]
        open_.append((first, end, left, right))
    return [(a, b, r - l) for a, b, l, r in open_]


@dataclass
class ToxicModel:
    score: np.ndarray  # by code, float32
    rate: float  # lambda
    scale: float  # K
    weights: tuple[float, ...]  # of features()

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, int]:
        """(evidence of the strongest passage, number of passages with evidence over 0); 0 stands for none."""
        own = [self.rate * s - np.log(self.scale * max(n, 1)) for _, _, s in segments]
        return (float(np.clip(max(own, default=0.0), 0.0, MOST)), sum(e > 0 for e in own))

    def probability(self, evidence: np.ndarray, passages: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-features(evidence, passages) @ np.array(self.weights)))


def features(evidence: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """What the regression reads: a constant, evidence, the logarithm of passages and whether there are several."""
    return np.stack((np.ones(len(evidence)), evidence, np.log1p(passages), passages > 1), 1)


def code_scores(toxic: np.ndarray, clean: np.ndarray, rest: float = 0.0) -> np.ndarray:
    """Scores from document counts by code in the two classes; the prior is PRIOR times the pooled counts.

    rest: clean documents counted under all the other codes, which no toxic document has and which score -DRIFT.
    """
    both = toxic + clean
    if not toxic.sum() or not clean.sum() + rest:
        return np.full(len(both), -DRIFT, np.float32)
    prior = PRIOR * both + 0.05
    others = PRIOR * rest + 0.05 * (CODES - len(both))
    a, b = toxic + prior, clean + prior
    odds = np.log(a / (a.sum() + others - a)) - np.log(b / (b.sum() + rest + others - b))
    sure = odds / np.sqrt(1 / a + 1 / b)
    ok = (sure > SURE) & (toxic >= LEAST)
    return np.where(ok, odds * (1 - (SURE / np.maximum(sure, SURE)) ** 2), -DRIFT).astype(np.float32)


def tail_rate(score: np.ndarray, share: np.ndarray) -> float:
    """lambda > 0 with E[exp(lambda * s)] = 1 under the shares of the codes, by bisection."""
    low, high = 1e-6, 20.0
    excess = lambda x: float((share * np.expm1(np.minimum(x * score, 60.0))).sum())
    for _ in range(60):
        mid = (low + high) / 2
        if excess(mid) < 0:
            low = mid
        else:
            high = mid
    return low


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 100) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; steps are halved until the loss, which is convex, falls."""
    w = np.zeros(x.shape[1])
    loss = lambda w: np.sum(np.logaddexp(0, x @ w) - y * (x @ w)) + ridge / 2 * w @ w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        slope = x.T @ (y - p) - ridge * w
        step, now = np.linalg.solve(hess, slope), loss(w)
        while loss(w + step) > now - 1e-4 * slope @ step and np.abs(step).max() > 1e-10:
            step /= 2
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> DataFrame:
    """(toxic, part, text): the texts of at most per_class ids of each label that are not held out, least hash first.

    An id with several labels, and a text that several of these ids have, has the largest and counts once; so the
    sample does not depend on how rows are laid. Its ids are at most 2 * per_class and are broadcast; only its own texts
    are moved. part: 0 to 3, by the text.
    """
    ids = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    ids = least_hashes(ids.withColumn("rank", F.xxhash64(F.lit(5), "doc_id")), "toxic", "rank", per_class).select("doc_id", "toxic")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(ids), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    return rows.select("toxic", F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int").alias("part"), "text")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by part, code and class, and the tokens of clean documents."""
    docs, words = np.zeros((PARTS, 2, CODES), np.int32), np.zeros((PARTS, CODES), np.int64)
    for batch in batches:
        data, offsets = text_buffer(batch.column(2))
        label, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i, j in spans_of(offsets, CHUNK):
            codes, _, _, at = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for k in range(j - i):
                own, n = np.unique(codes[at[k] : at[k + 1]], return_counts=True)
                docs[part[i + k], label[i + k], own] += 1
                if not label[i + k]:
                    words[part[i + k], own] += n
    part, code = np.nonzero(docs.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, code, docs[part, 1, code].astype(np.int64), docs[part, 0, code].astype(np.int64), words[part, code])], names=["part", "code", "toxic", "clean", "words"])


def _rated(codes: np.ndarray, counts: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, float]:
    """(scores of all codes, lambda): counts of toxic and clean documents and of tokens of clean ones, by code; of the last two, the rest."""
    toxic, clean, words = counts
    score = np.full(CODES, -DRIFT, np.float32)
    score[codes] = own = code_scores(toxic, clean, rest[0])
    if not (own > 0).any():
        return score, 1.0
    share = np.append(words, rest[1]) + 1e-3
    return score, tail_rate(np.append(own, -DRIFT).astype(float), share / share.sum())


def _passages(score, batches: Iterator[pa.RecordBatch], column: int, part_column: int | None = None) -> Iterator[tuple[int, list[tuple[int, int, float]], int, np.ndarray, np.ndarray, pa.RecordBatch]]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(column))
        for i, j in spans_of(offsets, CHUNK):
            codes, start, end, at = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            value = score[codes] if part_column is None else score[np.repeat(batch.column(part_column).to_numpy()[i:j], np.diff(at)), codes]
            hot = np.concatenate(([0], np.cumsum(value > 0)))
            for k in range(j - i):
                a, b = at[k], at[k + 1]
                found = maximal_segments(value[a:b].astype(np.float64)) if hot[b] > hot[a] else []
                base = offsets[i + k] - offsets[i]
                yield i + k, found, int(b - a), start[a:b] - base, end[a:b] - base, batch


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> ToxicModel:
    """The model: scores from the whole sample, calibrated crosswise.

    Each of four parts is scored by the counts of the other three; these figures give K and the logistic weights.
    Without any labelled text everything scores alike, at a share of SHARE: nothing is toxic.

    To the driver come the counts of codes that toxic texts have (2^18 at most) and one row of three figures for each
    text of the sample, both bounded. Equal
    however the tables are partitioned.
    """
    sample = written(labelled_sample(docs, labels, id_col, text_col, label_col, per_class), "sample")
    kinds, parts = ("toxic", "clean", "words"), range(PARTS)
    counted = sample.mapInArrow(_counts, "part long, code long, toxic long, clean long, words long")
    counted = counted.groupBy("code").agg(*[F.sum(F.when(F.col("part") == p, F.col(k)).otherwise(0)).alias(f"{k}{p}") for p in parts for k in kinds])
    counted = written(counted.withColumn("hot", F.expr(" + ".join(f"toxic{p}" for p in parts)) > 0), "codes")
    by_code = counted.where("hot").toPandas()
    others = counted.where("not hot").agg(*[F.coalesce(F.sum(f"{k}{p}"), F.lit(0)).alias(f"{k}{p}") for p in parts for k in kinds[1:]]).first()
    codes = by_code["code"].to_numpy(np.int64)
    counts = np.array([[by_code[f"{k}{p}"].to_numpy(float) for k in kinds] for p in parts]).reshape(PARTS, 3, len(codes))
    rest = np.array([[float(others[f"{k}{p}"]) for k in kinds[1:]] for p in parts])
    score, rate = zip(*[_rated(codes, counts.sum(0) - own, rest.sum(0) - o) for own, o in ((*zip(counts, rest, strict=True), (0, 0)))], strict=True)
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(np.stack(score[:PARTS]))
    level = np.log(20.0) / np.array(rate)

    def high_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = above = 0
        for k, found, n, _, _, batch in _passages(sent.value, batches, 2, 1):
            seen, above = seen + n, above + sum(s >= level[batch.column(1)[k].as_py()] for _, _, s in found)
        yield pa.RecordBatch.from_pydict({"seen": [int(seen)], "above": [int(above)]})

    tail = sample.where("toxic = 0").mapInArrow(high_segments, "seen long, above long").agg(F.sum("seen").alias("seen"), F.sum("above").alias("above")).first()
    scale = max(tail.above or 0, 1) * 20.0 / max(tail.seen or 0, 1)
    model = ToxicModel(score[PARTS], rate[PARTS], scale, (0.0,) * 4)
    rates = [ToxicModel(score[PARTS][:0], r, scale, (0.0,) * 4) for r in rate]

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(batch.column(0)[k].as_py(), *rates[batch.column(1)[k].as_py()].evidence(found, n)) for k, found, n, _, _, batch in _passages(sent.value, batches, 2, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.float64(), pa.int64()))], names=["toxic", "evidence", "passages"])

    held = sorted(tuple(r) for r in sample.mapInArrow(figures, "toxic int, evidence double, passages long").collect())
    if len({toxic for toxic, _, _ in held}) == 2:
        toxic, evidence, passages = (np.array(x, float) for x in zip(*held, strict=True))
        model.weights = tuple(float(w) for w in logistic(features(evidence, passages), toxic))
    else:  # one class or none: the share seen, smoothed by ten texts with a share of SHARE
        toxic = sum(t for t, _, _ in held)
        model.weights = (float(np.log((toxic + 10 * SHARE) / (len(held) - toxic + 10 * (1 - SHARE)))), 0.0, 0.0, 0.0)
    forget(sample, counted)
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, passages: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages) and, if asked for, starts and ends of significant passages in bytes.

    One row for each row of docs. Null and empty texts have no passage and get the score of that; a null id counts as
    held out. Repeated rows get equal scores, very long texts are scanned whole, an empty table gives no rows, and
    columns other than the two are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    lists = ", starts array<long>, ends array<long>" if passages else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value

        def flush(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
            score = own.probability(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
            columns = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array([r[1] for r in rows], pa.int64())]
            columns += [pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (2, 3)] if passages else []
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "n_passages", "starts", "ends"][: len(columns)])

        last, rows = None, []
        for _, found, n, start, end, batch in _passages(own.score, batches, 2):
            if last is not None and batch is not last:
                yield flush(last, rows)
                rows = []
            last = batch
            evidence, strong = own.evidence(found, n)
            sure = [(a, b) for a, b, s in found if own.rate * s > np.log(own.scale * max(n, 1))] if passages else []
            rows.append((evidence, strong, [int(start[a]) for a, _ in sure], [int(end[b - 1]) for _, b in sure]))
        if last is not None:
            yield flush(last, rows)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_passages long" + lists)


def without_toxic(docs: DataFrame, model: ToxicModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without the rows that score_toxicity would predict 1 for; all columns stay as they are, nothing is moved.

    Null and empty texts are scored like texts without a passage.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            figures = [own.evidence(found, n) for _, found, n, _, _, _ in _passages(own.score, iter([batch]), column)]
            score = own.probability(np.array([f[0] for f in figures]), np.array([f[1] for f in figures]))
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
