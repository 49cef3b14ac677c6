"""Language identification by a small convolutional network over bytes.

Bytes are embedded, convolved by filters of several widths, max-pooled over a
fixed-length window and classified by softmax. The network is trained in numpy
on the driver, on windows of a bounded sample of labelled rows: about
``per_language`` different texts of each language (fewer if there are more than
``most`` / ``per_language`` languages), ``windows_per_doc`` windows spread over
each. Every language with a text is learned, and none is dropped: more than
``max_languages`` are an error. It is then applied to all windows of every whole
text, in batches; a text's probabilities are the means over its windows,
weighted by their bytes. In inference a convolution is
a sum of table rows: embedding and filter are multiplied out for each byte.

A null text, and one without a letter, is ``und`` with score 0, as is every
text if no row has a label. Very long texts are judged in parts of their bytes.
Other columns are never inputs and come back unchanged, whatever their names.
Repeated rows get the same answer; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, judged

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
#: Lower-cases A-Z.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


@dataclass
class Model:
    languages: list[str]
    embed: np.ndarray  # bytes by EMBED
    filters: list[np.ndarray]  # by width: width by EMBED by FILTERS
    bias: np.ndarray  # of the filters
    dense: np.ndarray
    offset: np.ndarray

    def tables(self) -> list[np.ndarray]:
        return [np.ascontiguousarray(np.einsum("be,kef->kbf", self.embed, w)) for w in self.filters]


def windows_of(data: np.ndarray) -> np.ndarray:
    """All of a text's bytes in rows of WINDOW, the last padded with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = FOLD[data]
    return out.reshape(n, WINDOW)


def pooled(rows: np.ndarray, tables: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Max over positions of every filter, after ReLU."""
    out = []
    for t in tables:
        width = len(t)
        n = WINDOW - width + 1
        conv = t[0][rows[:, :n]]
        for k in range(1, width):
            conv += t[k][rows[:, k : k + n]]
        out.append(conv.max(axis=1))
    return np.maximum(np.concatenate(out, axis=1) + bias, 0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(samples: list[tuple[bytes, str]], rounds: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Model:
    """Adam on windows and their languages; the same samples in any order give the same network."""
    # A shorter copy of each window, so that short texts are met in training too.
    samples = sorted([*samples, *((b[: 32 + zlib.crc32(b) % 128], lang) for b, lang in samples)])
    languages = sorted({lang for _, lang in samples})
    x = np.concatenate([windows_of(np.frombuffer(b[:WINDOW], np.uint8)) for b, _ in samples])
    y = np.array([languages.index(lang) for _, lang in samples])
    share = np.bincount(y, minlength=len(languages)) / len(y)
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    p = {"embed": rng.normal(0, 0.3, (256, EMBED)), "bias": np.zeros(total), "dense": rng.normal(0, 0.3, (total, len(languages))), "offset": np.zeros(len(languages))}
    p |= {f"w{w}": rng.normal(0, 0.3, (w, EMBED, FILTERS)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows, want = x[order[at : at + batch]], y[order[at : at + batch]]
            n = len(rows)
            g = {k: np.zeros_like(a) for k, a in p.items()}
            vectors = p["embed"][rows]
            best, maxima = [], []
            for w in WIDTHS:
                size = WINDOW - w + 1
                conv = sum(vectors[:, k : k + size] @ p[f"w{w}"][k] for k in range(w))
                best.append(conv.argmax(axis=1))
                maxima.append(np.take_along_axis(conv, best[-1][:, None], axis=1)[:, 0])
            pre = np.concatenate(maxima, axis=1) + p["bias"]
            feature = np.maximum(pre, 0)
            d = softmax(feature @ p["dense"] + p["offset"])
            d[np.arange(n), want] -= 1
            d *= (1 / (len(languages) * share[want]))[:, None] / n
            g["dense"], g["offset"] = feature.T @ d, d.sum(axis=0)
            back = (d @ p["dense"].T) * (pre > 0)
            g["bias"] = back.sum(axis=0)
            for j, w in enumerate(WIDTHS):
                e = back[:, j * FILTERS : (j + 1) * FILTERS]
                for k in range(w):
                    where = best[j] + k  # only the maxima carry a gradient
                    byte = np.take_along_axis(rows, where, axis=1)
                    g[f"w{w}"][k] = np.einsum("nfe,nf->ef", p["embed"][byte], e)
                    np.add.at(g["embed"], byte, e[:, :, None] * p[f"w{w}"][k].T[None])
            step += 1
            for key, a in p.items():
                m[key] = 0.9 * m[key] + 0.1 * g[key]
                v[key] = 0.999 * v[key] + 0.001 * g[key] ** 2
                a -= rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)
    return Model(languages, p["embed"], [p[f"w{w}"] for w in WIDTHS], p["bias"], p["dense"], p["offset"])


def sample_windows(docs: DataFrame, per_language: int = 400, windows_per_doc: int = 3, max_languages: int = 2_000, most: int = 8_000) -> list[tuple[bytes, str]]:
    """Windows of a bounded sample of labelled rows (text, lang), chosen by a hash of the text: copies are drawn together and count once."""
    rows = docs.filter("lang is not null").select("lang", F.encode("text", "UTF-8").alias("data")).filter(F.length("data") > 0)
    draw = F.pmod(F.xxhash64("data"), F.lit(1_000_000))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("data")).alias("n"), F.min(draw).alias("least")).limit(max_languages + 1).collect()
    if not sizes:
        return []
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    per_language = max(4, min(per_language, most // len(sizes)))
    # At least the text with the least hash is in a language's sample.
    below = [(r["lang"], max(int(min(1.0, per_language / r["n"]) * 1_000_000), r["least"] + 1)) for r in sizes]
    rates = docs.sparkSession.createDataFrame(below, "lang string, below long")
    rows = rows.join(F.broadcast(rates), "lang").filter(draw < F.col("below"))  # at most max_languages rows
    spread = F.transform(F.sequence(F.lit(0), F.lit(windows_per_doc - 1)), lambda i: F.substring(F.col("data"), (i * F.greatest(F.length("data") - WINDOW, F.lit(0)) / max(1, windows_per_doc - 1)).cast("int") + 1, F.lit(WINDOW)))
    cut = rows.select("lang", F.explode(F.array_distinct(spread)).alias("w")).distinct()
    # Each language's windows in the order of their hashes; beyond twice the number aimed at, only equal hashes could bring more.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("w"), "w"))
    chosen = cut.withColumn("k", rank).filter(F.col("k") <= 2 * per_language * windows_per_doc)
    return [(bytes(r["w"]), r["lang"]) for r in chosen.select("w", "lang").collect()]


def predict_languages(docs: DataFrame, model: Model | None, per_step: int = 128) -> DataFrame:
    """``docs`` with a last column, a struct of lang_pred and score.

    It is called ``_lang``, with more underscores while ``docs`` has a column that starts like it.
    """
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
    tables = model.tables() if model else None

    def probabilities(text: str) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        total = np.zeros(len(model.languages))
        for first in range(0, len(data), per_step * WINDOW):
            rows = windows_of(data[first : first + per_step * WINDOW])
            size = np.minimum(WINDOW, len(data) - first - WINDOW * np.arange(len(rows)))
            total += size @ softmax(pooled(rows, tables, model.bias) @ model.dense + model.offset)
        return total / len(data)

    def judge(text: str | None) -> dict:
        if not model or not text or not any(map(str.isalpha, text)):
            return {"lang_pred": "und", "score": 0.0}
        p = probabilities(text)
        best = int(p.argmax())
        return {"lang_pred": model.languages[best], "score": float(min(1.0, max(0.0, p[best])))}

    def per_batch(texts: pa.Array) -> pa.Array:
        return pa.array([judge(t.as_py()) for t in texts], kind)

    return judged(docs, per_batch, free(docs.columns, "_lang"), "struct<lang_pred:string,score:double>")


def fit(docs: DataFrame, **sample) -> Model | None:
    """A network from the labelled rows (text, lang); None without any."""
    windows = sample_windows(docs, **sample)
    return train(windows) if windows else None
