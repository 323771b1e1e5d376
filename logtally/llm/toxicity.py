"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own embedding (words seen in training) next to the mean embedding of its
hashed character trigrams (all words). Two gated recurrent layers read a window of words from both
ends; attention weighs the states of both into one vector, and a logistic unit scores it. A
document's score is that of its worst window; windows overlap and cover all of it.

Labels belong to documents, so each round of training picks the worst window of every sampled
document under the current weights, together with random windows of clean ones. At the start the
worst window is the one with the word most typical of labelled documents, which is also where one
coordinate of the word embedding starts.

The network is fitted on a bounded sample of labelled rows (``TrainSettings``), on the driver; its
weights (about 1 MB) are broadcast, and every document is scored where it lies, window batches at a
time, without a shuffle.

Results for odd input: a null text or one without words scores 0; repeated rows score alike;
extra columns are ignored; without labelled rows of both classes every text scores 0.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns

WORDS = re.compile(r"\w+")
#: Words that a worker holds projected, and words scored together; bounds of memory only.
MEMO_WORDS = 150_000
GROUP_WORDS = 50_000


@dataclass(frozen=True)
class TrainSettings:
    """``clean_rows`` and ``toxic_rows`` bound the sample of labelled documents."""

    clean_rows: int = 1_000
    toxic_rows: int = 800
    vocabulary: int = 12_000
    char_buckets: int = 4_096
    width: int = 8
    hidden: int = 8
    window: int = 32
    #: Half a window: any expression of up to 17 words is whole in one.
    stride: int = 16
    rounds: int = 8
    least_updates: int = 300
    """A small sample takes more rounds, to make so many steps."""
    batch: int = 64
    rate: float = 0.01
    seed: int = 3


def windows(words: int, settings: TrainSettings) -> range:
    """Starts of the overlapping windows that cover ``words`` words."""
    return range(0, max(1, words - (settings.window - settings.stride)), settings.stride)


def char_grams(words: Sequence[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of the padded words, and the word each belongs to."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode(), np.uint8).astype(np.uint32)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = (codes[:-2] * np.uint32(0x9E3779B1)) ^ (codes[1:-1] * np.uint32(0x85EBCA77)) ^ (codes[2:] * np.uint32(0xC2B2AE3D))
    owner = np.cumsum(codes == ord("^")) - 1
    inside = owner[:-2] == owner[2:]
    return ((mixed ^ (mixed >> np.uint32(15))) % np.uint32(buckets))[inside].astype(np.int64), owner[:-2][inside]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    settings: TrainSettings
    vocabulary: dict[str, int]
    """Rows of the word embedding; row 0 stands for all other words."""
    weights: dict[str, np.ndarray]
    memo: dict[str, int] = field(default_factory=dict)
    memo_rows: list[np.ndarray] = field(default_factory=list)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "memo_rows": []}

    # -- inputs ---------------------------------------------------------------------------------

    def features(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: embedding rows, character buckets and the word each bucket belongs to."""
        rows = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        return rows, *char_grams(words, self.settings.char_buckets)

    def inputs(self, rows: np.ndarray, buckets: np.ndarray, owner: np.ndarray) -> np.ndarray:
        w = self.weights
        chars = np.zeros((len(rows), self.settings.width), np.float32)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
        if len(starts):
            chars[owner[starts]] = np.add.reduceat(w["chars"][buckets], starts, axis=0) / np.diff(np.r_[starts, len(owner)])[:, None]
        return np.concatenate([w["words"][rows], chars], axis=1)

    def projected(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights
        return x @ w["in_f"] + w["bias_f"], x @ w["in_b"] + w["bias_b"]

    # -- the network over windows -----------------------------------------------------------------

    def _read(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray, recurrent: np.ndarray, steps, keep: list | None) -> np.ndarray:
        """States after each step (steps x windows x hidden), of one direction."""
        h = self.settings.hidden
        state = np.zeros((index.shape[0], h), np.float32)
        states = np.zeros((index.shape[1], index.shape[0], h), np.float32)
        for t in steps:
            x, m = table[index[:, t]], mask[:, t, None]
            g = state @ recurrent
            gates = _sigmoid(x[:, : 2 * h] + g[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            n = np.tanh(x[:, 2 * h :] + r * g[:, 2 * h :])
            new = n + z * (state - n)
            new = np.where(m, new, state)
            if keep is not None:
                keep.append((t, state, g[:, 2 * h :], z, r, n, m))
            states[t] = state = new
        return states

    def forward(self, tables: tuple[np.ndarray, np.ndarray], index: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Score of each window. ``index``: rows of the tables (windows x steps); ``mask``: real words."""
        w, steps = self.weights, range(index.shape[1])
        logs = ([], []) if keep is not None else (None, None)
        ahead = self._read(tables[0], index, mask, w["rec_f"], steps, logs[0])
        back = self._read(tables[1], index, mask, w["rec_b"], reversed(steps), logs[1])
        states = np.concatenate([ahead, back], axis=2)
        pull = np.where(mask.T, states @ w["attention"], np.float32(-1e9))
        share = np.exp(pull - pull.max(axis=0))
        share /= share.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", share, states)
        score = _sigmoid(pooled @ w["out"] + w["out_bias"])
        if keep is not None:
            keep.update(states=states, share=share, pooled=pooled, logs=logs)
        return score

    def gradients(self, words: tuple, index: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss of the windows and its gradient by all weights."""
        w, h, keep = self.weights, self.settings.hidden, {}
        x = self.inputs(*words)
        tables = self.projected(x)
        score = self.forward(tables, index, mask, keep)
        loss = -np.mean(np.where(target > 0, np.log(score + 1e-7), np.log(1 - score + 1e-7)))
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        d_out = ((score - target) / len(target)).astype(np.float32)
        grads["out"] = keep["pooled"].T @ d_out
        grads["out_bias"] = d_out.sum(keepdims=True)
        d_pooled = d_out[:, None] * w["out"]
        states, share = keep["states"], keep["share"]
        d_share = np.einsum("bh,tbh->tb", d_pooled, states)
        d_pull = share * (d_share - (share * d_share).sum(axis=0))
        grads["attention"] = np.einsum("tb,tbh->h", d_pull, states)
        d_states = share[:, :, None] * d_pooled + d_pull[:, :, None] * w["attention"]
        d_x = np.zeros_like(x)
        for name, log, table, part in (("f", keep["logs"][0], tables[0], slice(0, h)), ("b", keep["logs"][1], tables[1], slice(h, 2 * h))):
            recurrent = w[f"rec_{name}"]
            d_table = np.zeros_like(table)
            carried = np.zeros((len(target), h), np.float32)
            for t, state, g_n, z, r, n, m in reversed(log):
                d_new = d_states[t, :, part] + carried
                live = np.where(m, d_new, 0)
                d_n = live * (1 - z) * (1 - n * n)
                d_z = live * (state - n) * z * (1 - z)
                d_r = d_n * g_n * r * (1 - r)
                d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
                carried = live * z + np.where(m, 0, d_new) + d_g @ recurrent.T
                grads[f"rec_{name}"] += state.T @ d_g
                np.add.at(d_table, index[:, t], np.concatenate([d_z, d_r, d_n], axis=1))
            grads[f"bias_{name}"] = d_table.sum(axis=0)
            grads[f"in_{name}"] = x.T @ d_table
            d_x += d_table @ w[f"in_{name}"].T
        rows, buckets, owner = words
        width = self.settings.width
        np.add.at(grads["words"], rows, d_x[:, :width])
        counts = np.maximum(np.bincount(owner, minlength=len(rows)), 1).astype(np.float32)
        np.add.at(grads["chars"], buckets, (d_x[:, width:] / counts[:, None])[owner])
        return float(loss), grads

    # -- documents ----------------------------------------------------------------------------------

    def layout(self, lengths: Sequence[int], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of texts whose word rows follow one another: index, mask, and each text's first window."""
        s = self.settings
        starts, firsts, ends, base = [], [], [], 0
        for n in lengths:
            firsts.append(len(starts))
            starts += [base + a for a in windows(n, s)]
            ends += [base + n] * (len(starts) - firsts[-1])
            base += n
        at = np.array(starts, np.int64)[:, None] + np.arange(s.window)
        mask = at < np.array(ends, np.int64)[:, None]
        return rows[np.minimum(at, base - 1)], mask, np.array(firsts, np.int64)

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Rows of ``memo_rows`` for words, adding those not yet there."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        rows = np.fromiter(map(self.memo.get, words, itertools.repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(rows < 0).tolist()
        if missing:
            first, new = len(self.memo), list(dict.fromkeys(words[i] for i in missing))
            self.memo.update(zip(new, itertools.count(first)))
            rows[missing] = [self.memo[words[i]] for i in missing]
            tables = self.projected(self.inputs(*self.features(new)))
            if not self.memo_rows or len(self.memo) > len(self.memo_rows[0]):
                room = 2 * len(self.memo)
                self.memo_rows = [np.concatenate([*(x[:first] for x in self.memo_rows[at : at + 1]), np.zeros((room - first, t.shape[1]), np.float32)]) for at, t in enumerate(tables)]
            for held, table in zip(self.memo_rows, tables, strict=True):
                held[first : len(self.memo)] = table
        return rows

    def score_windows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all windows of texts (each of one word or more), and each text's first window."""
        rows = self.word_rows([w for words in texts for w in words])
        index, mask, firsts = self.layout([len(words) for words in texts], rows)
        return self.forward(tuple(self.memo_rows), index, mask), firsts

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        """Score of each text, its worst window's."""
        scores = np.zeros(len(texts))
        group, places, size = [], [], 0

        def flush() -> None:
            if group:
                found, firsts = self.score_windows(group)
                scores[places] = np.maximum.reduceat(found, firsts)

        for i, text in enumerate(texts):
            words = WORDS.findall(text.lower()) if text else []
            # A very long text goes in overlapping pieces of whole windows.
            step = GROUP_WORDS // self.settings.stride * self.settings.stride
            for a in range(0, max(1, len(words) - (self.settings.window - self.settings.stride)), step):
                piece = words[a : a + step + self.settings.window - self.settings.stride]
                if not piece:
                    continue
                if len(words) > step:
                    found, _ = self.score_windows([piece])
                    scores[i] = max(scores[i], found.max())
                    continue
                group.append(piece)
                places.append(i)
                size += len(piece)
            if size >= GROUP_WORDS:
                flush()
                group, places, size = [], [], 0
        flush()
        return np.clip(scores, 0.0, 1.0)


def _start(texts: list[list[str]], labels: np.ndarray, settings: TrainSettings) -> Network:
    """Random weights, but for the coordinate that tells how typical of labelled texts a word is."""
    rng = np.random.default_rng(settings.seed)
    seen, with_label = Counter(), Counter()
    for words, label in zip(texts, labels, strict=True):
        distinct = set(words)
        seen.update(distinct)
        if label:
            with_label.update(distinct)
    share = labels.sum() / len(labels)
    typical = {w: abs(with_label[w] - n * share) / (n * share * (1 - share) + 1) ** 0.5 for w, n in seen.items() if n > 2}
    kept = sorted(typical, key=lambda w: (-typical[w], w))[: settings.vocabulary]
    vocabulary = {w: i + 1 for i, w in enumerate(kept)}
    d, h = settings.width, settings.hidden
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    weights = {
        "words": normal(len(vocabulary) + 1, d, scale=0.1),
        "chars": normal(settings.char_buckets, d, scale=0.1),
        "attention": normal(2 * h, scale=0.1),
        "out": normal(2 * h, scale=0.3),
        "out_bias": np.zeros(1, np.float32),
    }
    for name in "fb":
        weights |= {
            f"in_{name}": normal(2 * d, 3 * h, scale=0.3),
            f"rec_{name}": normal(h, 3 * h, scale=0.3),
            f"bias_{name}": np.zeros(3 * h, np.float32),
        }
    clean = max(1, len(labels) - int(labels.sum()))
    for word, row in vocabulary.items():
        a = (with_label[word] + 0.5) / (labels.sum() + 1)
        b = (seen[word] - with_label[word] + 0.5) / (clean + 1)
        weights["words"][row, 0] = np.clip(np.log(a / b), -3, 3) / 3
    weights["words"][0] = 0
    return Network(settings, vocabulary, weights)


def train(texts: Sequence[str | None], labels: Sequence[int], settings: TrainSettings = TrainSettings()) -> Network | None:
    """The network of a sample of labelled texts, or None unless both classes are there."""
    split = [(WORDS.findall(t.lower()), y) for t, y in zip(texts, labels, strict=True) if t]
    split = [(words, y) for words, y in split if words]
    target = np.array([y for _, y in split], np.float32)
    if not len(target) or target.min() == target.max():
        return None
    words = [w for w, _ in split]
    net = _start(words, target, settings)
    rng = np.random.default_rng(settings.seed)
    distinct = {w: i for i, w in enumerate(dict.fromkeys(x for ws in words for x in ws))}
    features = net.features(list(distinct))
    bounds = np.searchsorted(features[2], np.arange(len(distinct) + 1))
    rows = np.fromiter((distinct[x] for ws in words for x in ws), np.int64)
    index, mask, firsts = net.layout([len(ws) for ws in words], rows)
    counts = np.diff(np.r_[firsts, len(index)])
    owner = np.repeat(np.arange(len(words)), counts)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    step = 0
    turn = 0
    while turn < settings.rounds or step < settings.least_updates:
        if turn == 0:
            typical = net.weights["words"][features[0], 0]
            worst = np.where(mask, typical[index], -9).max(axis=1)
        else:
            tables = net.projected(net.inputs(*features))
            worst = np.concatenate([net.forward(tables, index[a : a + 4096], mask[a : a + 4096]) for a in range(0, len(index), 4096)])
        turn += 1
        order = np.lexsort((-worst, owner))
        picked = order[firsts]
        others = (firsts + rng.integers(0, 1 << 30, len(firsts)) % counts)[target == 0]
        chosen = rng.permutation(np.concatenate([picked, others]))
        for a in range(0, len(chosen), settings.batch):
            some = chosen[a : a + settings.batch]
            used, local = np.unique(index[some], return_inverse=True)
            grams = np.concatenate([np.arange(bounds[u], bounds[u + 1]) for u in used])
            part = (features[0][used], features[1][grams], np.repeat(np.arange(len(used)), bounds[used + 1] - bounds[used]))
            _, grads = net.gradients(part, local.reshape(len(some), -1), mask[some], target[owner[some]])
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.weights[k] -= settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def score_toxicity(docs: DataFrame, network: Network | None, keep: Sequence[str | Column]) -> DataFrame:
    """The ``keep`` columns and ``score``."""
    if network is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(network)
    return add_columns(docs, keep, [F.col("text")], "score double", lambda t: [pa.array(shared.value.score(t.to_pylist()), pa.float64())])
