"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

A text's terms are trigrams of its lower-cased bytes and trigrams of its character classes
(letter cases, digits and each punctuation mark; runs of one class count once), both hashed.
Weighted by log frequency and rarity they are projected on the leading singular directions of a
bounded sample of labelled texts (``FitSettings``). The sample's vectors and labels, about 1 MB, are
broadcast. Every document is compared with all of them, in blocks, by exact cosine products; the
``neighbours`` nearest vote with their similarity as weight.

Results for odd input: a null or empty text, which has no vector, gets the sample's share of label
1; repeated rows score alike; extra columns are ignored; a sample of no rows gives 0.5 throughout.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, text_of

SHAPE_TERMS, BYTE_TERMS = 1 << 13, 1 << 13
TERMS = SHAPE_TERMS + BYTE_TERMS
#: Texts compared with the sample at a time; bounds memory only.
BLOCK = 256


@dataclass(frozen=True)
class FitSettings:
    """Bounds of the labelled sample, and of the space."""

    rows_of_0: int = 1_200
    rows_of_1: int = 1_800
    dimensions: int = 48
    neighbours: int = 15
    seed: int = 13


def _classes() -> bytes:
    """For each byte its class: lower-case and other letters, upper-case, digits, or itself."""
    table = bytearray(range(256))
    for b in range(256):
        c = chr(b)
        table[b] = ord("a") if b >= 128 or "a" <= c <= "z" else ord("A") if "A" <= c <= "Z" else ord("0") if c.isdigit() else b
    return bytes(table)


_CLASSES = _classes()


def _hashed(codes: np.ndarray, terms: int) -> np.ndarray:
    x = codes.astype(np.uint32)
    grams = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    return (grams ^ (grams >> np.uint32(16))) % np.uint32(terms)


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a text and how often each occurs."""
    data = text.encode() if text else b""
    if len(data) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    classes = np.frombuffer(data.translate(_CLASSES), np.uint8)
    shape = classes[np.r_[True, classes[1:] != classes[:-1]]]
    counts = np.zeros(TERMS, np.int32)
    if len(shape) >= 3:
        counts[:SHAPE_TERMS] = np.bincount(_hashed(shape, SHAPE_TERMS), minlength=SHAPE_TERMS)
    counts[SHAPE_TERMS:] = np.bincount(_hashed(np.frombuffer(data.lower(), np.uint8), BYTE_TERMS), minlength=BYTE_TERMS)
    terms = np.flatnonzero(counts)
    return terms.astype(np.int32), counts[terms]


@dataclass
class QualityModel:
    settings: FitSettings
    rarity: np.ndarray
    directions: np.ndarray
    """Terms x dimensions."""
    vectors: np.ndarray
    """Unit vectors of the labelled sample."""
    labels: np.ndarray

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (np.log1p(counts) * self.rarity[terms]).astype(np.float32) @ self.directions[terms]

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        scores = np.full(len(texts), self.labels.mean())
        for a in range(0, len(texts), BLOCK):
            vectors = np.vstack([self.vector(*term_counts(t)) for t in texts[a : a + BLOCK]])
            lengths = np.linalg.norm(vectors, axis=1)
            real = lengths > 0
            near = (vectors[real] / lengths[real, None]) @ self.vectors.T
            k = min(self.settings.neighbours, near.shape[1])
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, best, axis=1), 0) + 1e-6
            scores[a : a + BLOCK][real] = (weight * self.labels[best]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(scores, 0.0, 1.0)


def fit(sample: DataFrame, settings: FitSettings = FitSettings()) -> QualityModel:
    """``sample``: text and label (0 or 1), of bounded size. Terms are counted where the rows lie."""

    def count(texts: pa.Array) -> list[pa.Array]:
        rows = [term_counts(t.as_py()) for t in texts]
        return [pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in (0, 1)]

    counted = add_columns(sample, ["doc_id", "label"], [text_of()], "terms array<int>, counts array<int>", count).toArrow().sort_by("doc_id")
    rows = [(np.array(t, np.int64), np.array(c, np.float32)) for t, c in zip(counted["terms"].to_pylist(), counted["counts"].to_pylist(), strict=True)]
    labels = counted["label"].to_numpy().astype(np.float32)
    held = [i for i, (t, _) in enumerate(rows) if len(t)]
    labels = labels[held]
    rows = [rows[i] for i in held]
    if not rows:
        return QualityModel(settings, np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    present = np.zeros(TERMS)
    for terms, _ in rows:
        present[terms] += 1
    rarity = np.log((1 + len(rows)) / (1 + present)).astype(np.float32)
    weights = [(t, np.log1p(c) * rarity[t]) for t, c in rows]
    weights = [(t, v / max(float(np.linalg.norm(v)), 1e-9)) for t, v in weights]
    # Singular directions through the sample's products, a slice of terms at a time.
    products = np.zeros((len(rows), len(rows)), np.float32)
    slices = [(a, a + 2_048) for a in range(0, TERMS, 2_048)]

    def dense(a: int, b: int) -> np.ndarray:
        block = np.zeros((len(rows), b - a), np.float32)
        for i, (terms, values) in enumerate(weights):
            inside = (terms >= a) & (terms < b)
            block[i, terms[inside] - a] = values[inside]
        return block

    for a, b in slices:
        block = dense(a, b)
        products += block @ block.T
    values, vectors = np.linalg.eigh(products)
    kept = np.argsort(values)[::-1][: min(settings.dimensions, len(rows))]
    kept = kept[values[kept] > 1e-6]
    basis = (vectors[:, kept] / np.sqrt(values[kept])).astype(np.float32)
    directions = np.vstack([dense(a, b).T @ basis for a, b in slices])
    model = QualityModel(settings, rarity, directions, np.zeros((0, 1), np.float32), labels)
    projected = np.vstack([v.astype(np.float32) @ directions[t] for t, v in weights])
    lengths = np.maximum(np.linalg.norm(projected, axis=1, keepdims=True), 1e-9)
    model.vectors = (projected / lengths).astype(np.float32)
    return model


def score_quality(docs: DataFrame, model: QualityModel, keep: Sequence[str | Column]) -> DataFrame:
    """The ``keep`` columns and ``score``, the share of label 1 among the neighbours by weight."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return add_columns(docs, keep, [F.col("text")], "score double", lambda t: [pa.array(shared.value.score(t.to_pylist()), pa.float64())])
