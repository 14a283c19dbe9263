"""Quality classifier from weak labels.

Overlapping heuristic labellers vote clean, junk or nothing on every document. Expectation-maximisation over the counts of vote patterns (at most
3**labellers rows, whatever the corpus) estimates how often each labeller is right under either class, and with that the posterior of every pattern. The
posteriors of a bounded sample then train a hashed linear scorer, which judges every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_WORDS, Rolling, added, arrow_rows, cut, flat_text, input_rows, mixed, word_bounds
from .routing import chunks

#: Sizes of the scorer: hashed dimensions, and the documents that it is trained on at most (about this many, chosen by hash of the id).
DIMS, TRAIN_DOCS = 1 << 13, 6000
CLEAN, JUNK, NONE = 1, 0, 2

_CLASS = np.full(256, ord("a"), np.uint8)  # bytes to character classes: letters by case, digits, and every other ASCII character as itself
_CLASS[:128] = np.arange(128)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = ord("A"), ord("a"), ord("0")
_CLASS[[9, 11, 12, 13]] = 32


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def repeated_share(hashes: np.ndarray, firsts: np.ndarray, width: int) -> np.ndarray:
    """The share of each text's windows of ``width`` words that stand in it twice or more."""
    n_words = np.diff(firsts)
    n = np.maximum(n_words - width + 1, 0)
    grams = Rolling(hashes).grams(width)
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.repeat(firsts[:-1], n)
    keys = mixed(grams[at] ^ mixed(text.astype(np.uint64)))
    _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = np.bincount(text, weights=times[back] > 1, minlength=len(n))
    return again / np.maximum(n, 1)


def signals(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Per text the figures that the labellers look at; also the bytes and offsets."""
    raw, offsets = flat_text(texts)
    starts, ends, firsts = word_bounds(raw, offsets)
    words = np.maximum(np.diff(firsts), 1)
    hashes = Rolling(BYTE_WORDS[raw]).of(starts, ends)
    upper, letters = _sums((raw >= 65) & (raw <= 90), offsets), _sums(((raw | 32) >= 97) & ((raw | 32) <= 122), offsets)
    per_word = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[firsts]) / words
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[firsts[:-1][np.diff(firsts) > 0]] = False  # the word before a text's first is another text's
    symbol = np.isin(raw, np.frombuffer(b"#*$%&|<>", np.uint8))
    return {
        "n_words": np.diff(firsts), "symbols": _sums(symbol, offsets) / words, "upper": upper / np.maximum(letters, 1), "bang": _sums(raw == 33, offsets) / words,
        "bar": _sums(raw == 124, offsets) / words, "repeat": repeated_share(hashes, firsts, 3), "same": per_word(same),
    }, raw, offsets


#: labeller -> votes junk where it holds, nothing elsewhere. Each knows one kind of junk, so its silence says nothing about the others.
JUNK_SIGNS = {
    "symbols": lambda x: x["symbols"] > 0.1, "capitals": lambda x: x["upper"] > 0.4, "shouting": lambda x: x["bang"] > 0.15, "table": lambda x: x["bar"] > 0.1,
    "repeats": lambda x: (x["repeat"] > 0.35) & (x["n_words"] >= 60), "stutter": lambda x: (x["same"] > 0.1) & (x["n_words"] >= 10),
}
#: labeller -> votes clean where it holds, nothing elsewhere.
CLEAN_SIGNS = {"prose": lambda x: (x["symbols"] < 0.02) & (x["bang"] < 0.05) & (x["upper"] < 0.2) & (x["same"] < 0.05) & ((x["repeat"] < 0.2) | (x["n_words"] < 60))}
LABELLERS = [*JUNK_SIGNS, *CLEAN_SIGNS]


def votes(found: dict[str, np.ndarray]) -> np.ndarray:
    """Texts by labellers; a text without words gets no vote."""
    some = found["n_words"] > 0
    return np.stack([np.where(sign(found) & some, says, NONE) for signs, says in ((JUNK_SIGNS, JUNK), (CLEAN_SIGNS, CLEAN)) for sign in signs.values()], axis=1).astype(np.int8)


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """EM over vote patterns (patterns by labellers, and how many documents have each): the share of clean documents, and (class, labeller, vote) rates.

    Votes are taken as independent within a class. It starts from clean where no labeller says junk, with half a document added to every rate.
    """
    post = np.where((patterns == JUNK).any(1), 0.1, 0.9)
    prior, rates = 0.5, np.full((2, patterns.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        new_prior = (weight[1].sum() + 0.5) / (counts.sum() + 1)
        for v in range(3):
            rates[:, :, v] = weight @ (patterns == v) + 0.5
        rates /= rates.sum(2, keepdims=True)
        new = posterior(patterns, new_prior, rates)
        done = abs(new_prior - prior) < 1e-9 and np.abs(new - post).max(initial=0) < 1e-7
        prior, post = new_prior, new
        if done:
            break
    return float(prior), rates


def posterior(patterns: np.ndarray, prior: float, rates: np.ndarray) -> np.ndarray:
    """The probability of being clean for each pattern of votes."""
    k = np.arange(patterns.shape[1])
    logs = np.log(rates[:, k, patterns]).sum(2)
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - prior) / prior), -500, 500)))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each text as sorted (text, dimension, value) triples of norm 1 a text: four-grams of character classes, and steps of the repetition figures."""
    found, raw, offsets = signals(texts)
    n_texts, size = len(offsets) - 1, len(raw)
    text = np.repeat(np.arange(n_texts), np.diff(offsets))
    grams = np.zeros(max(size - 3, 0), np.uint64)
    kinds = _CLASS[raw].astype(np.uint64)
    for j in range(4):
        grams = grams * np.uint64(131) + kinds[j : size - 3 + j]
    inside = text[: len(grams)] == text[3:] if size > 3 else np.zeros(0, bool)
    dims = (mixed(grams[inside]) % np.uint64(DIMS - 64)).astype(np.int64) + 64
    cells, times = np.unique(text[: len(grams)][inside] * DIMS + dims, return_counts=True)
    value = np.sqrt(times)
    steps = []
    for j, name in enumerate(("repeat", "same", "symbols")):
        steps.append(np.arange(n_texts) * DIMS + 8 * j + np.minimum((found[name] * 8).astype(np.int64), 7))
    norm = np.sqrt(np.bincount(cells // DIMS, weights=times, minlength=n_texts))
    value = value / np.maximum(norm, 1e-9)[cells // DIMS]
    cells, value = np.concatenate([cells, *steps]), np.concatenate([value, np.full(3 * n_texts, 0.5)])
    return cells // DIMS, cells % DIMS, value


def _vote_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = 3 ** np.arange(len(LABELLERS))
    for b in batches:
        for first, texts in chunks(b.column(1)):
            codes = votes(signals(texts)[0]).astype(np.int64) @ base
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(codes)], names=["_id", "_pattern"])


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, texts in chunks(b.column(1)):
            text, dim, value = features(texts)
            order = np.argsort(text, kind="stable")
            cuts = np.searchsorted(text[order], np.arange(len(texts) + 1)).astype(np.int32)
            dims = pa.ListArray.from_arrays(cuts, pa.array(dim[order].astype(np.int32)))
            values = pa.ListArray.from_arrays(cuts, pa.array(value[order].astype(np.float32)))
            pattern = votes(signals(texts)[0]).astype(np.int64) @ (3 ** np.arange(len(LABELLERS)))
            yield pa.RecordBatch.from_arrays([b.column(2).slice(first, len(texts)), pa.array(pattern), dims, values], names=["_order", "_pattern", "_dims", "_values"])


def decode(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(len(LABELLERS))) % 3


def train_scorer(rows: pd.DataFrame, clean: np.ndarray, rounds: int = 150, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by adaptive gradient steps over all rows; both classes weigh the same."""
    text = np.repeat(np.arange(len(rows)), [len(x) for x in rows["_dims"]])
    dim = np.concatenate([*rows["_dims"], np.zeros(0, np.int64)]).astype(np.int64)
    value = np.concatenate([*rows["_values"], np.zeros(0)]).astype(np.float64)
    weight = clean / max(clean.sum(), 1e-9) + (1 - clean) / max((1 - clean).sum(), 1e-9)
    w, bias, seen, seen_bias = np.zeros(DIMS), 0.0, np.full(DIMS, 1e-8), 1e-8
    for _ in range(rounds if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(text, weights=w[dim] * value, minlength=len(rows)) + bias, -30, 30)))
        off = (p - clean) * weight
        slope, slope_bias = np.bincount(dim, weights=off[text] * value, minlength=DIMS) + decay * w, off.sum()
        seen += slope**2
        seen_bias += slope_bias**2
        w -= rate / 4 * slope / np.sqrt(seen)
        bias -= rate / 4 * slope_bias / np.sqrt(seen_bias)
    return w, bias


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> dict:
    """Weights of the scorer, and what EM found. Votes of all documents are counted; only the scorer is trained on a sample, by hash of id and text.

    To the driver come the counts of vote patterns (3**7 at most) and the features of about ``train_docs`` documents.
    """
    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    counted = rows.mapInArrow(_vote_batches, f"_id {kind}, _pattern long").groupBy("_pattern").count().orderBy("_pattern").toPandas()
    counts = counted["count"].to_numpy(np.float64)
    prior, rates = fit_labellers(decode(counted["_pattern"].to_numpy(np.int64)), counts)
    share = min(1.0, train_docs / max(counts.sum(), 1))
    rows = rows.select("_id", "_text", F.xxhash64("_id", "_text").alias("_order"))
    picked = rows if share == 1 else rows.where(F.pmod("_order", F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = picked.mapInArrow(_feature_batches, "_order long, _pattern long, _dims array<int>, _values array<float>").toPandas()
    sample = sample.sort_values("_order", kind="stable").reset_index(drop=True)  # sums come out alike however the rows were dealt
    w, bias = train_scorer(sample, posterior(decode(sample["_pattern"].to_numpy(np.int64)), prior, rates))
    return {"weights": w, "bias": bias, "clean_share": prior, "rates": rates}


def score_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with _quality (0 to 1) and _n_words (``common.added`` names). The model is a few ten thousand numbers; it goes with the tasks."""
    quality, n_words = added(docs.columns, "_quality", "_n_words")
    arrow_rows(docs.sparkSession)
    w, bias = model["weights"], float(model["bias"])
    at = docs.columns.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, n = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for first, texts in chunks(b.column(at)):
                text, dim, value = features(texts)
                out[first : first + len(texts)] = np.bincount(text, weights=w[dim] * value, minlength=len(texts)) + bias
                n[first : first + len(texts)] = np.diff(word_bounds(*flat_text(texts))[2])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30)))), pa.array(n)], names=[*b.schema.names, quality, n_words])

    schema = docs.select("*", F.lit(0.0).alias(quality), F.lit(0).cast("long").alias(n_words)).schema
    return docs.mapInArrow(scored, schema)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``docs`` with _quality, _n_words and _kept; where docs has such a column itself, the added one gets the name that ``common.added`` gives.

    A text without a word (null or empty too) gets no vote; it is scored like any other but kept only with a word in it. Whole texts count. An empty table
    gives an empty table. Repeated rows get the same score.
    """
    model = fit(docs, id_col, text_col, train_docs)
    quality, n_words, kept = added(docs.columns, "_quality", "_n_words", "_kept")
    return score_documents(docs, model, id_col, text_col).withColumn(kept, (F.col(quality) >= threshold) & (F.col(n_words) > 0))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(input_rows(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.round("_quality", 6).alias("quality"), F.col("_kept").alias("kept"))
