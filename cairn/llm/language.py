"""Language of texts, by hierarchical discrimination (operator 2).

First a language family is predicted, by one-versus-rest linear support vector machines; then, within it, one-versus-one
linear support vector machines separate its languages and the one with most wins (then the largest summed margin) is taken.
Features are counts of character 1- to 3-grams of lower-cased letters, hashed, dampened and scaled to unit length.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from cairn.llm.shared import slices

#: Families by language code; a language that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
    "sinitic": ("zh", "yue"),
}
#: Hashed features, and texts of each language that the machines are fitted on (the bound of the sample).
DIMENSIONS, SAMPLE = 1 << 12, 400
UNDETERMINED = "und"


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.split("-")[0].lower() in members), f"only-{lang}")


def features(texts: list[str | None], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """A row for each text (float32, unit length; zero without letters), and whether it has a letter."""
    out = np.zeros((len(texts), dimensions), np.float32)
    lettered = np.zeros(len(texts), bool)
    shift = np.uint32(32 - dimensions.bit_length() + 1)
    for i, text in enumerate(texts):
        if not text:
            continue
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        letter = _is_letter(codes)
        if not letter.any():
            continue
        lettered[i] = True
        codes = np.where(letter, codes, np.uint32(32))
        # runs of other characters count as one space
        codes = np.concatenate(([np.uint32(32)], codes[letter | np.append(True, letter[:-1])], [np.uint32(32)])).astype(np.uint32)
        one = codes * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (codes[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (codes[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        row = sum(np.bincount((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift, minlength=dimensions) for x in (one, two, three))
        row = np.sqrt(row.astype(np.float32))
        out[i] = row / np.linalg.norm(row)
    return out, lettered


_LETTERS: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS[codes]


def fit_svm(x: np.ndarray, y: np.ndarray, epochs: int = 30, strength: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear support vector machine by averaged stochastic subgradient steps in a fixed order; y is -1 or 1."""
    n, d = x.shape
    w, b, mean_w, mean_b, t = np.zeros(d), 0.0, np.zeros(d), 0.0, 0
    weight = np.where(y > 0, n / max(1, 2 * (y > 0).sum()), n / max(1, 2 * (y < 0).sum()))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(n), max(1, n // 32)):
            t += 1
            rate = 1 / (strength * (t + 1000))
            wrong = part[y[part] * (x[part] @ w + b) < 1]
            step = (weight * y)[wrong] / len(part)
            w = (1 - rate * strength) * w + rate * (step @ x[wrong]) * 0.01
            b += rate * step.sum() * 0.0001
            mean_w += (w - mean_w) / t
            mean_b += (b - mean_b) / t
    return mean_w, mean_b


class Model(NamedTuple):
    languages: tuple[str, ...]
    families: tuple[str, ...]
    family_w: np.ndarray
    family_b: np.ndarray
    pairs: dict[str, tuple[tuple[str, str, np.ndarray, float], ...]]
    members: dict[str, tuple[str, ...]]


def fit(x: np.ndarray, langs: list[str]) -> Model | None:
    """None without any language."""
    languages = tuple(sorted(set(langs)))
    if not languages:
        return None
    members: dict[str, list[str]] = {}
    for lang in languages:
        members.setdefault(family(lang), []).append(lang)
    families = tuple(sorted(members))
    own = np.array(langs)
    of = np.array([family(v) for v in langs])
    first = [fit_svm(x, np.where(of == f, 1.0, -1.0)) if len(families) > 1 else (np.zeros(x.shape[1]), 0.0) for f in families]
    pairs = {}
    for f, langs_of in members.items():
        pairs[f] = []
        for a, b in combinations(langs_of, 2):
            rows = (own == a) | (own == b)
            pairs[f].append((a, b, *fit_svm(x[rows], np.where(own[rows] == a, 1.0, -1.0))))
    return Model(languages, families, np.array([w for w, _ in first]), np.array([b for _, b in first]), {f: tuple(v) for f, v in pairs.items()}, {f: tuple(v) for f, v in members.items()})


def predict(model: Model | None, x: np.ndarray, lettered: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Languages and scores: the chance that both decisions are right, by logistic curves over their margins."""
    out, scores = [UNDETERMINED] * len(x), np.zeros(len(x))
    if model is None:
        return out, scores
    margins = x @ model.family_w.T + model.family_b
    chosen = margins.argmax(axis=1)
    sure = lambda m: 1 / (1 + np.exp(-np.clip(4 * m, -50, 50)))
    for k, name in enumerate(model.families):
        rows = np.flatnonzero((chosen == k) & lettered)
        if not len(rows):
            continue
        members = model.members[name]
        wins, sums = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
        lowest = np.full((len(rows), len(members)), np.inf)
        for a, b, w, bias in model.pairs[name]:
            m = x[rows] @ w + bias
            for lang, margin in ((a, m), (b, -m)):
                at = members.index(lang)
                wins[:, at] += margin > 0 if lang == a else margin >= 0
                sums[:, at] += margin
                lowest[:, at] = np.minimum(lowest[:, at], margin)
        best = np.lexsort((-np.arange(len(members))[None, :].repeat(len(rows), 0), sums, wins), axis=1)[:, -1] if len(members) > 1 else np.zeros(len(rows), int)
        score = sure(margins[rows, k]) if len(model.families) > 1 else np.ones(len(rows))
        if len(members) > 1:
            score = score * sure(lowest[np.arange(len(rows)), best])
        for r, at, s in zip(rows, best, score, strict=True):
            out[r], scores[r] = members[at], s
    return out, scores


def fitted(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> Model | None:
    """Machines fitted on up to ``sample`` texts of each language (the same for the same rows: first by a hash of the id).

    Rows without a language, and texts that are null or without letters, teach nothing. Features are made where the texts
    are; the driver receives at most ``sample`` feature rows a language. The sample is found in two steps, on ids first.
    """
    rows = labelled.select(labelled[id_col].alias("id"), labelled[lang_col].alias("lang"), labelled[text_col].alias("text")).where("lang is not null and text rlike '\\\\p{L}'")
    slot = F.xxhash64(F.col("id").cast("string"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2 * sample / n))).otherwise(share)
    # twice the sample by hash, then exactly the first by rank; only languages with many rows are thinned
    drawn = rows.withColumn("slot", slot).where((F.col("slot") / F.lit(float(1 << 64)) + 0.5) < share)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("slot", T.LongType()), T.StructField("row", T.BinaryType())])

    def run(batches):
        for batch in batches:
            texts, kept = batch.column("text"), []
            for part in slices((len(t.as_buffer()) if t.is_valid else 0 for t in texts), 1 << 20):
                kept += [v.astype(np.float16).tobytes() for v in features(texts[part.start : part.stop].to_pylist(), dimensions)[0]]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("slot"), pa.array(kept, pa.binary())], names=schema.names)

    ranked = drawn.select("lang", "slot", "text").mapInArrow(run, schema).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("slot", "row"))).where(F.col("rank") <= sample)
    found = sorted(ranked.select("lang", "slot", "row").collect())
    x = np.array([np.frombuffer(r["row"], np.float16) for r in found], np.float32).reshape(len(found), dimensions)
    return fit(x, [r["lang"] for r in found])


def identified(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), dimensions: int = DIMENSIONS) -> DataFrame:
    """One row per row of docs: the kept columns, ``lang_pred`` and ``score``.

    ``und`` with score 0 for a null text, one without a letter, or where nothing was learned. Repeated rows are each
    predicted. Only the text is an input. There is no shuffle.
    """
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep))
            for part in slices((len(t.as_buffer()) if t.is_valid else 0 for t in texts), 2 << 20):
                langs, scores = [], []
                for some in range(part.start, part.stop, 512):
                    found, sure = predict(shared.value, *features(texts[some : min(some + 512, part.stop)].to_pylist(), dimensions))
                    langs += found
                    scores += sure.tolist()
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[part.start : part.stop] for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*(docs[c] for c in keep), docs[text_col].alias("__text")).mapInArrow(run, schema)
