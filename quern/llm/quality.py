"""Quality classifier: a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checked, row_keys, table, text_slices

_UPPER, _LOWER, _DIGIT = range(65, 91), range(97, 123), range(48, 58)
_KINDS = np.zeros((9, 256))
for _k, _bytes in enumerate((_UPPER, _LOWER, _DIGIT, b".,;:?'\"()-", b"#%&*$@^~=+_<>{}[]\\/`", b"|", b"!", range(128, 256), b" \t\r\x0b\x0c")):
    _KINDS[_k, list(_bytes)] = 1
_MARKS = b"#%&*$@^~=+_<>{}[]\\/`|!"

#: The statistics, in order; each is a function of the whole text alone.
STATISTICS = (
    "log_words", "word_bytes", "upper", "digits", "stops", "symbols", "pipes", "shouts", "high_bytes", "blanks", "log_lines", "words_a_line",
    "distinct_words", "repeats", "top_word", "distinct_pairs", "repeated_lines", "marked_words", "one_byte_words", "packed", "capital_words",
)


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a text; an empty text has them too. Fractions go through log(x + 1/200)."""
    n = max(1, len(text))
    counts = _KINDS @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(1.0, counts[0] + counts[1])
    words = text.split()
    w = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    seen = Counter(words)
    part = lambda x, of: math.log(x / of + 0.005)
    return [
        math.log1p(len(words)), math.log1p(sum(map(len, words)) / w), part(counts[0], letters), part(counts[2], n), part(counts[3], n), part(counts[4], n), part(counts[5], n), part(counts[6], n),
        part(counts[7], n), part(counts[8], n), math.log1p(len(lines)), math.log1p(len(words) / m),
        math.log1p(len(seen)) / math.log1p(w) if words else 0.0, part(sum(map(bytes.__eq__, words, words[1:])), w), part(max(seen.values(), default=0), w),
        math.log1p(len(set(zip(words, words[1:], strict=False)))) / math.log1p(w) if words else 0.0,
        part(len(lines) - len(set(lines)), m), part(sum(x[-1] in _MARKS for x in words), w), part(sum(len(x) == 1 for x in words), w), math.log((len(zlib.compress(text, 1)) + 20) / (n + 20)),
        part(sum(x[0] in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" for x in words), w),
    ]


def document_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows' `keep` columns and stats array<double>, one vector a row; null texts count as empty."""
    checked(docs, text)
    source = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            for start, texts in text_slices(batch):
                flat = np.array([x for t in texts for x in statistics(t)])
                stats = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(STATISTICS), dtype=np.int32), pa.array(flat))
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], stats], names=[*[f"c{i}" for i in range(len(keep))], "stats"])

    fields = "".join(f"c{i} {source.schema[f'c{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    out = source.mapInArrow(run, f"{fields}stats array<double>")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "stats")


@dataclass
class Discriminant:
    """Two Gaussians over standardised statistics; whitening factors are inverse Cholesky factors, made once."""

    centre: np.ndarray
    spread: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    logs: np.ndarray
    soften: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -12, 12)
        density = [self.logs[c] - 0.5 * (((z - self.means[c]) @ self.factors[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) * self.soften, -60, 60)))


def fit_discriminant(rows: DataFrame, label: str = "label", shrink: float = 0.1) -> Discriminant:
    """Fit on all rows (stats array<double>, label 0 or 1; others are ignored).

    Only sums reach the driver: for each class, the count, the statistics' sums and their products'
    sums, made in each task and added up by Spark; their number depends on the statistics alone.
    Class covariances are shrunk towards the pooled one and its diagonal. With one class or none
    among the rows, the other keeps the pooled Gaussian, and the prior decides.
    """
    p = len(STATISTICS)
    rows = rows.select(F.col(f"`{label}`").cast("int").alias("label"), "stats").where("label IN (0, 1)")

    def sums(batches):
        total = np.zeros((2, p + 1, p + 1))
        for b in batches:
            y = b.column("label").to_numpy(zero_copy_only=False)
            x = b.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            x = np.hstack([np.ones((len(x), 1)), x])
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
        c, i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(i), pa.array(j), pa.array(total[c, i, j])], names=["c", "i", "j", "v"])

    got = rows.mapInArrow(sums, "c long, i long, j long, v double").groupBy("c", "i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, p + 1, p + 1))
    for r in got:
        total[r.c, r.i, r.j] = r.v
    counts = total[:, 0, 0]
    if not counts.sum():
        return Discriminant(np.zeros(p), np.ones(p), np.zeros((2, p)), np.array([np.eye(p)] * 2), np.zeros(2))
    everything = total.sum(axis=0)
    centre = everything[0, 1:] / counts.sum()
    spread = np.sqrt(np.maximum(np.diag(everything)[1:] / counts.sum() - centre**2, 1e-6))
    means, scatters = np.zeros((2, p)), np.zeros((2, p, p))
    for c in (0, 1):
        if counts[c]:
            mean = total[c, 0, 1:] / counts[c]
            means[c] = (mean - centre) / spread
            scatters[c] = (total[c, 1:, 1:] - counts[c] * np.outer(mean, mean)) / np.outer(spread, spread)
    pooled = scatters.sum(axis=0) / counts.sum()
    factors, logs = np.zeros((2, p, p)), np.zeros(2)
    for c in (0, 1):
        own = scatters[c] / max(1.0, counts[c])
        towards = max(shrink, p / (p + counts[c]))
        cov = (1 - towards) * own + towards * (0.5 * pooled + 0.5 * np.diag(np.diag(pooled))) + 1e-3 * np.eye(p)
        low = np.linalg.cholesky(cov)
        factors[c] = np.linalg.inv(low)
        logs[c] = math.log((counts[c] + 1) / (counts.sum() + 2)) - np.log(np.diag(low)).sum()
    return Discriminant(centre, spread, means, factors, logs)


def score_documents(stats: DataFrame, model: Discriminant) -> DataFrame:
    """All columns but stats, and score double: the model's probability of label 1."""
    names = [c for c in stats.columns if c not in ("stats", "score")]
    source = stats.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], "stats")

    def run(batches):
        for b in batches:
            x = b.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(model.scores(x))], names=[*[f"c{i}" for i in range(len(names))], "score"])

    fields = "".join(f"c{i} {source.schema[f'c{i}'].dataType.simpleString()}, " for i in range(len(names)))
    out = source.mapInArrow(run, f"{fields}score double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "score")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Score each row of docs (doc_id, text) for quality: `keep` columns, held_out, score.

    Labels (doc_id, quality) of rows outside the held-out quarter are learned from, all of them; a
    document's id only picks its fold and joins its label. Statistics are made once for each row and
    written to the shared folder; the fit and the scores read them from there. Null and empty texts
    are scored like others. Null ids learn nothing and are not held out. Repeated rows each get a
    score; a document with several labels is learned from with each. Without labels, scores are 0.5.
    """
    checked(docs, "doc_id", "text")
    checked(labels, "doc_id", "quality")
    scratch = Scratch(docs.sparkSession, "quality")
    columns = tuple(dict.fromkeys(("doc_id", *keep)))
    stats = scratch.save(document_statistics(docs, keep=columns), "stats")
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__label")).where(~held_out(F.col("doc_id")))
    model = fit_discriminant(stats.join(known, F.col("doc_id") == F.col("__id")).select("__label", "stats"), "__label")
    return score_documents(stats, model).select(*[F.col(f"`{c}`") for c in columns if c in keep], held_out(F.col("doc_id")).alias("held_out"), "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """Documents whose score is `least` or more, all columns; rows are matched by content, so repeated rows stay together."""
    keys = row_keys(F.col("doc_id"), F.col("text"))
    keyed = docs.withColumns({"__k1": keys[0], "__k2": keys[1]})
    scored = quality_scores(keyed, labels, keep=("__k1", "__k2"))
    good = scored.where(F.col("score") >= least).select("__k1", "__k2").distinct()
    return keyed.join(good, ["__k1", "__k2"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
