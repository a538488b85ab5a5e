"""Language identification by a convolutional network over bytes, trained and applied with numpy.

A text's UTF-8 bytes are cut into consecutive windows of WINDOW bytes, the last
one padded with zeros, so the whole text is seen. A byte is embedded, filters of
several widths slide over the window, each keeps its maximum (rectified), and a
softmax turns the maxima into probabilities. A text's probabilities are the mean
over its windows, weighted by their bytes.

Training takes a bounded sample, WINDOWS_A_ROW windows a row: ROWS_A_LANG rows of each label at most, those with
the smallest hashes of id and text, and fewer where there are so many labels that all
rows would be more than MOST_ROWS (one row of each label at least).
Since an embedded byte times a filter column is a number that depends on the
byte alone, inference sums entries of two tables indexed by byte pairs.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; rows
with null lang, null text or the held-out remainder teach nothing; without any
labelled row every text is ``und`` and :func:`recognised` rejects none. Only label counts and the sample are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words
from .shared import written

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 8, 8
ROWS_A_LANG, WINDOWS_A_ROW, MOST_ROWS = 600, 4, 200_000
STEPS, BATCH, RATE = 500, 64, 0.01
UNDETERMINED = "und"


@dataclass
class Network:
    langs: list[str]
    weights: dict[str, np.ndarray]  # embedding, w2, w3, w4 (width*EMBEDDING x FILTERS), b, dense, bias

    @staticmethod
    def fresh(langs: list[str], seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        weights = {"embedding": r.normal(0, 0.5, (256, EMBEDDING)), "b": np.zeros(FILTERS * len(WIDTHS)), "dense": r.normal(0, 0.2, (FILTERS * len(WIDTHS), len(langs))), "bias": np.zeros(len(langs))}
        weights |= {f"w{w}": r.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)) for w in WIDTHS}
        return Network(langs, {k: v.astype(np.float32) for k, v in weights.items()})

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of windows x (n x WINDOW+3) with labels y, and its gradients; only the maxima's patches carry any."""
        p, n = self.weights, len(x)
        embedded = np.ascontiguousarray(p["embedding"][x])
        pooled, patches, places = [], [], []
        for w in WIDTHS:
            views = np.lib.stride_tricks.sliding_window_view(embedded, (w, EMBEDDING), (1, 2))[:, :WINDOW, 0].reshape(n, WINDOW, -1)
            out = views @ p[f"w{w}"]
            at = out.argmax(axis=1)  # n x FILTERS
            pooled.append(np.take_along_axis(out, at[:, None], 1)[:, 0])
            patches.append(views[np.arange(n)[:, None], at])
            places.append(at)
        raw = np.concatenate(pooled, axis=1) + p["b"]
        hidden = np.maximum(raw, 0)
        scores = hidden @ p["dense"] + p["bias"]
        prob = softmax(scores)
        loss = float(-np.log(prob[np.arange(n), y] + 1e-9).mean())
        d = prob
        d[np.arange(n), y] -= 1
        d /= n
        g = {"dense": hidden.T @ d, "bias": d.sum(0)}
        dh = (d @ p["dense"].T) * (raw > 0)
        g["b"] = dh.sum(0)
        g["embedding"] = np.zeros_like(p["embedding"])
        for k, w in enumerate(WIDTHS):
            dk = dh[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"w{w}"] = np.einsum("nfe,nf->ef", patches[k], dk)
            back = np.einsum("nf,ef->nfe", dk, p[f"w{w}"]).reshape(n, FILTERS, w, EMBEDDING)
            seen = x[np.arange(n)[:, None, None], places[k][:, :, None] + np.arange(w)]
            np.add.at(g["embedding"], seen.ravel(), back.reshape(-1, EMBEDDING))
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> Network:
        """Adam (Kingma, Ba 2015) over batches with as many windows of each language as of any other."""
        r = np.random.default_rng(seed)
        of = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(w) for k, w in self.weights.items()}
        for t in range(1, steps + 1):
            pick = np.array([r.choice(of[k]) for k in r.integers(0, len(of), BATCH)])
            _, g = self.gradients(x[pick], y[pick])
            rate = RATE * (1 - 0.9 * t / steps)
            for k in self.weights:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                self.weights[k] = (self.weights[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What bytes (i, i+1) and bytes (i+2, i+3) add to every filter's output at i; rows by first * 256 + second."""
        p = self.weights
        part = lambda w, j: p["embedding"] @ p[f"w{w}"][j * EMBEDDING : (j + 1) * EMBEDDING] if j < w else np.zeros((256, FILTERS), np.float32)
        pair = lambda j: np.concatenate([(part(w, j)[:, None] + part(w, j + 1)[None]).reshape(65536, FILTERS) for w in WIDTHS], axis=1)
        return np.ascontiguousarray(pair(0), np.float32), np.ascontiguousarray(pair(2)[:, FILTERS:], np.float32)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x WINDOW+3 bytes, each window's document, each window's number of bytes)."""
    lengths = np.diff(offsets)
    count = -(-lengths // WINDOW)
    first = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(lengths)), count)
    flat = np.zeros(int(first[-1]) * WINDOW, np.uint8)
    flat[np.arange(len(raw)) + np.repeat(first[:-1] * WINDOW - offsets[:-1], lengths)] = raw
    padded = np.zeros((len(doc), WINDOW + 3), np.uint8)
    padded[:, :WINDOW] = flat.reshape(-1, WINDOW)
    return padded, doc, np.minimum(WINDOW, lengths[doc] - (np.arange(len(doc)) - first[doc]) * WINDOW)


class Predictor:
    def __init__(self, network: Network):
        self.network, (self.near, self.far) = network, network.tables()

    def probabilities(self, x: np.ndarray, at_once: int = 256) -> np.ndarray:
        p, out = self.network.weights, []
        for k in range(0, len(x), at_once):
            part = x[k : k + at_once].astype(np.int32)
            pairs = part[:, :-1] * 256 + part[:, 1:]
            sums = np.take(self.near, pairs[:, :WINDOW].ravel(), axis=0)
            sums[:, FILTERS:] += np.take(self.far, pairs[:, 2:].ravel(), axis=0)
            best = sums.reshape(len(part), -1)
            while best.shape[1] > FILTERS * len(WIDTHS):
                half = best.shape[1] // 2
                best = np.maximum(best[:, :half], best[:, half:])
            out.append(softmax(np.maximum(best + p["b"], 0) @ p["dense"] + p["bias"]))
        return np.concatenate(out) if out else np.zeros((0, len(self.network.langs)), np.float32)

    def documents(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, its probability) of each text."""
        raw, offsets = words.utf8(column)
        n = len(offsets) - 1
        lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        x, doc, size = windows(raw, offsets)
        prob = self.probabilities(x) * size[:, None]
        mean = np.zeros((n, len(self.network.langs)))
        np.add.at(mean, doc, prob)
        mean /= np.maximum(mean.sum(axis=1, keepdims=True), 1e-12)
        best = mean.argmax(axis=1)
        score = np.where(lettered, np.clip(mean[np.arange(n), best], 0, 1), 0.0)
        return [self.network.langs[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)], score


def train(labelled: DataFrame, rows_a_lang: int = ROWS_A_LANG) -> Network | None:
    """Fit a network on a bounded sample of rows (doc_id, text, lang); None if there are none."""
    rows = labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    counts = written(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("count")), "labels")  # of different rows: repeated ones share a hash
    n_langs = counts.count()
    if not n_langs:
        return None
    most = min(rows_a_lang, max(1, MOST_ROWS // n_langs))
    # Hashes below the share of twice as many rows as wanted, so little is sorted; then exactly the smallest ones.
    scale = 1 << 30
    share = counts.select("lang", F.least(F.lit(scale), F.ceil((2 * most + 64) * scale / F.col("count"))).cast("long").alias("share"))
    data, n = F.encode("text", "UTF-8"), F.octet_length("text")
    cut = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_A_ROW - 1)), lambda j: F.substring(data, F.lit(1) + F.floor(j * F.greatest(n - WINDOW, F.lit(0)) / (WINDOWS_A_ROW - 1)).cast("int"), F.lit(WINDOW)))
    drawn = rows.join(share, "lang").filter(F.pmod("h", F.lit(scale)) < F.col("share"))
    drawn = drawn.select("lang", F.pmod("h", F.lit(scale)).alias("place"), "h", cut.alias("windows"))
    # Different rows first: repeated ones only take places that are left.
    drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "h").orderBy("place"))).filter(F.col("nth") <= most)
    sample = drawn.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("nth", "place", "h"))).filter(F.col("n") <= most).select("lang", "h", "windows").collect()
    sample.sort(key=lambda r: (r["lang"], r["h"]))
    langs = sorted({r["lang"] for r in sample})
    parts = [(bytes(w), langs.index(r["lang"])) for r in sample for w in dict.fromkeys(bytes(w) for w in r["windows"]) if w]
    if not parts:
        return None
    langs_seen = sorted({k for _, k in parts})
    x = np.zeros((len(parts), WINDOW + 3), np.uint8)
    for i, (w, _) in enumerate(parts):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    y = np.searchsorted(langs_seen, [k for _, k in parts])
    return Network.fresh([langs[k] for k in langs_seen]).fit(x, y)


def predict(docs: DataFrame, network: Network | None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, lang_pred, score of each row's text; a narrow map."""
    kept = docs.select(*columns, "text")
    if network is None:
        return kept.select(*columns, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(network)
        for batch in words.slices(batches):
            lang, score = predictor.documents(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*columns, "lang_pred", "score"])

    fields = ", ".join(f"`{kept.schema[c].name}` {kept.schema[c].dataType.simpleString()}" for c in columns)
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double")


def recognised(docs: DataFrame, network: Network | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is determined with a probability of ``least`` or more; a narrow map."""
    if network is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(network)
        for batch in words.slices(batches):
            lang, score = predictor.documents(batch.column("text"))
            yield batch.filter(pa.array([name != UNDETERMINED for name in lang]) if least <= 0 else pa.array(score >= least))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id's decimal text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, rows_a_lang: int = ROWS_A_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row, by a network that never saw the held-out rows."""
    network = train(docs.filter(~held_out(F.col("doc_id"))), rows_a_lang)
    return predict(docs, network).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
