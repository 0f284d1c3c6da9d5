"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over the text from every byte, each filter is max-pooled over overlapping chunks that cover the whole document, and the pooled chunks are
averaged and combined into one probability.  For inference the embedding and a filter's weights
for two neighbouring bytes are one table of 65,536 rows, so a filter costs a few additions a byte:
the table is applied to the byte pairs at even offsets and to those at odd ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import append_columns
from .sampling import labelled_sample

#: Byte pairs that a filter sees, filters, embedding size; byte pairs of a chunk, of its step.
PAIRS, FILTERS, EMBED = 8, 8, 6
CHUNK, STEP = 48, 32
#: Byte pairs convolved at a time, so that a long text needs no more memory than a short one (a multiple of STEP).
PIECE = STEP * 1024
#: Bounds of the sample that the network is fitted on: labelled rows, characters of a text.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 50_000
THRESHOLD = 0.3


def pairs(text: str | None) -> np.ndarray:
    """Codes of the byte pairs of a text, padded with zero bytes to one whole chunk at least."""
    raw = text.encode() if text else b""
    n = max(CHUNK, -(-(len(raw) + 1) // 2))
    return np.frombuffer(raw.ljust(2 * n, b"\0"), ">u2").astype(np.int64)


def shifted(codes: np.ndarray) -> np.ndarray:
    """Codes of the byte pairs that start one byte later (a zero byte follows the last pair)."""
    return ((codes & 255) << 8) | np.append(codes[1:] >> 8, 0)


def chunk_starts(n: int) -> np.ndarray:
    """Starts of overlapping chunks that cover n positions, the last one moved back to end with them."""
    return np.append(np.arange(0, max(n - CHUNK, 0), STEP), max(n - CHUNK, 0))


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # 2 * PAIRS x EMBED x FILTERS
    shift: np.ndarray  # FILTERS
    out: np.ndarray  # FILTERS
    bias: float
    prior: float | None = None  # without both labels in the sample: the score of every text

    def __post_init__(self) -> None:
        self._tables: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    def tables(self) -> np.ndarray:
        """PAIRS x 65536 x FILTERS: what a byte pair adds at each place of a filter."""
        if self._tables is None:
            one = np.einsum("be,kef->kbf", self.embed, self.filters).astype(np.float32)
            self._tables = (one[0::2, :, None, :] + one[1::2, None, :, :]).reshape(PAIRS, 65536, FILTERS)
        return self._tables

    def responses(self, codes: np.ndarray) -> np.ndarray:
        """Filter responses from the first byte of each pair (pairs past the end count as zero bytes)."""
        tables = self.tables()
        padded = np.append(codes, np.zeros(PAIRS - 1, np.int64))
        total = tables[0].take(codes, 0)
        for k in range(1, PAIRS):
            total += tables[k].take(padded[k : k + len(codes)], 0)
        return total

    def convolve(self, codes: np.ndarray) -> np.ndarray:
        """At each pair the larger of the filter responses from its two bytes."""
        even = self.responses(codes)
        return np.maximum(even, self.responses(shifted(codes)), out=even)

    def pooled(self, text: str | None) -> np.ndarray:
        """Mean over the chunks of each filter's rectified maximum."""
        codes = pairs(text)
        n, total, count = len(codes), np.zeros(FILTERS), 0
        for a in range(0, max(n - CHUNK, 0) + 1, PIECE):  # the chunks that start in this piece
            starts = chunk_starts(n)
            starts = starts[(starts >= a) & (starts < a + PIECE)]
            if len(starts):
                part = codes[a : starts[-1] + CHUNK]
                follow = codes[starts[-1] + CHUNK : starts[-1] + CHUNK + PAIRS]
                r = self.convolve(np.append(part, follow))[: len(part)]
                best = chunk_max(r, starts - a)
                total += np.maximum(best + self.shift, 0).sum(0)
                count += len(starts)
        return total / count

    def score(self, text: str | None) -> float:
        if self.prior is not None:
            return self.prior
        z = float(self.pooled(text) @ self.out + self.bias)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def chunk_max(r: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Maxima of the rows of ``r`` over the chunks at ``starts``."""
    half = CHUNK - STEP  # chunk = first `half` rows of a step, then the rest and `half` rows of the next
    regular = starts[: len(starts) - 1] if len(starts) and starts[-1] % STEP else starts
    out = []
    if len(regular):
        m = -(-(int(regular[-1]) + CHUNK) // STEP)
        grid = np.full((m * STEP, r.shape[1]), -np.inf, r.dtype)
        grid[: min(len(r), m * STEP)] = r[: m * STEP]
        grid = grid.reshape(m, STEP, -1)
        head = grid[:, :half].max(1)
        body = np.maximum(head, grid[:, half:].max(1))
        tail = np.vstack([head[1:], np.full((1, r.shape[1]), -np.inf, r.dtype)])
        out.append(np.maximum(body, tail)[: len(regular)])
    if len(regular) < len(starts):
        out.append(r[starts[-1] : starts[-1] + CHUNK].max(0)[None])
    return np.vstack(out)


def fit(sample: list[tuple[str, int]], epochs: int = 12, batch: int = 48, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam on the logistic loss; gradients pass to the position of each chunk's maximum only."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (256, EMBED)), rng.normal(0, 0.2, (2 * PAIRS, EMBED, FILTERS)), np.full(FILTERS, 0.1), rng.normal(0, 0.5, FILTERS), 0.0)
    labels = np.array([y for _, y in sample], float)
    if not len(labels) or labels.min() == labels.max():
        net.prior = float(labels.mean()) if len(labels) else 0.5
        return net
    codes = [pairs(t).astype(np.uint16) for t, _ in sample]
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    params = {"embed": net.embed, "filters": net.filters, "shift": net.shift, "out": net.out, "bias": np.zeros(1)}
    m, v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(sample))
        for chosen in (order[i : i + batch] for i in range(0, len(order), batch)):
            step += 1
            net._tables = None
            g = {k: np.zeros_like(x) for k, x in params.items()}
            at_byte = np.zeros(2 * PAIRS * 256 * FILTERS)
            for d in chosen:
                c = codes[d].astype(np.int64)
                late = shifted(c)
                even, odd = net.responses(c), net.responses(late)
                r = np.maximum(even, odd)
                starts = chunk_starts(len(c))
                if len(starts) > 64:  # a step looks at 64 chunks of a text, drawn anew each time
                    starts = np.sort(rng.choice(starts, 64, replace=False))
                windows = r[starts[:, None] + np.arange(CHUNK)]
                where = windows.argmax(1)
                top = np.take_along_axis(windows, where[:, None], 1)[:, 0] + net.shift
                pooled = np.maximum(top, 0).mean(0)
                p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + params["bias"][0], -60, 60)))
                dz = (p - labels[d]) * weight[d] / len(chosen)
                g["out"] += dz * pooled
                g["bias"] += dz
                dtop = dz * net.out * (top > 0) / len(starts)
                g["shift"] += dtop.sum(0)
                place = starts[:, None] + where
                from_odd = np.take_along_axis(odd > even, place, 0)[..., None]
                place = place[..., None] + np.arange(PAIRS)
                end = np.zeros(PAIRS, np.int64)
                seen = np.where(from_odd, np.append(late, end)[place], np.append(c, end)[place])
                seen = np.stack([seen >> 8, seen & 255], -1).reshape(len(starts), FILTERS, 2 * PAIRS)
                index = (np.arange(2 * PAIRS) * 256 + seen) * FILTERS + np.arange(FILTERS)[:, None]
                at_byte += np.bincount(index.ravel(), np.repeat(dtop.ravel(), 2 * PAIRS), len(at_byte))
            table = at_byte.reshape(2 * PAIRS, 256, FILTERS)
            g["embed"] = np.einsum("kbf,kef->be", table, net.filters)
            g["filters"] = np.einsum("be,kbf->kef", net.embed, table)
            for k, x in params.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                x -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    net.bias, net._tables = float(params["bias"][0]), None
    return net


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, rows: int = SAMPLE_ROWS) -> Network:
    return fit(labelled_sample(docs, labels, "quality", folds, fold, rows, SAMPLE_CHARS))


def score_quality(docs: DataFrame, model: Network, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1) and ``predicted`` (int): 1 for good text.

    Only the text is looked at, all of it.  Null texts count as empty ones, which are scored like
    any other (one chunk of zero bytes); repeated rows are scored each on its own; an empty table
    gives no rows.  A model fitted without both labels gives every text the share of label 1 in
    its sample (0.5 without rows).
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # about 10,000 numbers
    fields = [T.StructField("score", T.DoubleType())]
    scored = append_columns(docs, text, fields, lambda: lambda texts, _, own=sent.value: [[own.score(t) for t in texts]])
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Network, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with the columns of ``docs``."""
    from .blocks import set_aside

    aside = set_aside(docs, ["score", "predicted"])
    good = score_quality(docs.withColumnsRenamed(aside), model, aside.get(text, text)).where("predicted = 1")
    return good.drop("score", "predicted").withColumnsRenamed({b: a for a, b in aside.items()}).select([f"`{c}`" for c in docs.columns])
