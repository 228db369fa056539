"""Operator 10: document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features are its own shape (letter case, symbols,
punctuation, digits, word lengths, repeated words) and that of the lines before and after it; the
chain adds a score for each pair of neighbouring labels. Forward-backward gives each line's
probability of being good; their mean, weighted by line length, is the document's score.

Training: at most TRAIN labelled documents a class, those of least hash, none of the held-out ones;
all lines of each. Line labels are latent: only the document's label is known. First every line is
taken to have its document's label, then labels are those that the field expects (forward-backward)
when the document's label speaks for each line with EVIDENCE, so that an ordinary line of a bad
document may stay good; the chain is held small, else it would make all lines of a text alike.
Full-batch gradient steps from zero, so a rerun gives the same weights. Scoring reads whole texts.

Defined results: null or empty text is one empty line and gets a score; without labels of both
classes all scores are 0.5; repeated label rows vote once each; of the rows that share a doc_id the
least text is trained on, each is scored; rows with a null doc_id are scored and not held out; a
very long text takes about a kilobyte a line and steps in proportion to its lines; no rows give no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the training sample, in documents a class.
TRAIN = 1500
#: Gradient steps with given and with latent line labels, their rate, penalties of weights and chain.
STEPS, LATENT, RATE, PENALTY, CHAIN_PENALTY = 100, 100, 0.1, 1e-3, 0.05
#: What a document's label adds to the score of its label at each line while labels are latent.
EVIDENCE = 2.0
CELLS = 200_000
SYMBOLS = "#*$%&|<>"
KINDS = 6
_table: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """Kind of every code point below 65,536: 0 other letter, 1 upper case, 2 digit, 3 symbol,
    4 punctuation, 5 space. Points above count as letters."""
    if not _table:
        t = np.zeros(1 << 16, np.uint8)
        for k in range(1 << 16):
            c = chr(k)
            t[k] = 5 if c.isspace() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in SYMBOLS else 0 if c.isalpha() else 4
        _table.append(t)
    return _table[0]


N_OWN = 11
N_FEATURES = 3 * N_OWN + 2 + 1


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features of every line with its neighbours', lengths)."""
    lines = (text or "").split("\n")
    n = len(lines)
    points = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[np.minimum(points, 0xFFFF)]
    lengths = np.fromiter(map(len, lines), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    own = np.zeros((n, N_OWN))
    counts = np.zeros((n, KINDS))
    for k in range(KINDS):
        total = np.concatenate([[0], np.cumsum(kinds == k)])
        counts[:, k] = total[ends] - total[starts]
    letters, chars = counts[:, 0] + counts[:, 1], np.maximum(lengths - counts[:, 5], 1)
    own[:, 0] = np.log1p(lengths) / 5
    own[:, 1] = counts[:, 1] / np.maximum(letters, 1)
    own[:, 2] = np.minimum(1, 4 * counts[:, 3] / chars)
    own[:, 3] = np.minimum(1, 3 * counts[:, 4] / chars)
    own[:, 4] = counts[:, 2] / chars
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words = line.split()
        m = len(words)
        own[i, 5] = np.log1p(m) / 4
        if m:
            own[i, 6] = len(set(words)) / m
            own[i, 7] = sum(map(str.__eq__, words, words[1:])) / m
            own[i, 9] = line in seen
            own[i, 10] = words[0][:1].isupper() and line[-1:] in ".!?"
        seen.add(line)
    own[:, 8] = np.minimum(2, (chars / np.maximum(np.expm1(own[:, 5] * 4), 1)) / 8)
    out = np.zeros((n, N_FEATURES))
    out[:, :N_OWN] = own
    out[1:, N_OWN : 2 * N_OWN] = own[:-1]
    out[:-1, 2 * N_OWN : 3 * N_OWN] = own[1:]
    out[0, -3], out[-1, -2], out[:, -1] = 1, 1, 1
    return out, lengths


def marginals(emit: np.ndarray, size: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward in log space over padded chains. emit (docs, lines): score of good over bad;
    chain (2, 2): score of neighbouring labels. Returns P(good) and, summed over lines, the expected
    counts (docs, 2, 2) of neighbouring labels."""
    docs, most = emit.shape
    own = np.stack([np.zeros_like(emit), emit], 2)
    ahead, back = np.empty((docs, most, 2)), np.zeros((docs, most, 2))
    ahead[:, 0] = own[:, 0]
    for t in range(1, most):
        ahead[:, t] = own[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + chain, axis=1)
    for t in range(most - 2, -1, -1):
        b = np.logaddexp.reduce(chain + (own[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
        back[:, t] = np.where((t + 1 < size)[:, None], b, 0)
    z = np.logaddexp.reduce(ahead[np.arange(docs), size - 1], axis=1)
    good = np.exp(np.minimum(ahead[:, :, 1] + back[:, :, 1] - z[:, None], 0))
    pairs = np.zeros((docs, 2, 2))
    if most > 1:
        both = ahead[:, :-1, :, None] + chain + (own[:, 1:] + back[:, 1:])[:, :, None, :] - z[:, None, None, None]
        live = np.arange(1, most)[None, :] < size[:, None]
        pairs = np.where(live[:, :, None, None], np.exp(np.minimum(both, 0)), 0).sum(1)
    return np.minimum(good, 1), pairs


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in parts])
    out = np.zeros((len(parts), size.max(), N_FEATURES))
    for k, p in enumerate(parts):
        out[k, : len(p)] = p
    return out, size


def _batches(sizes: list[int]) -> Iterator[list[int]]:
    """Documents of like length together, so that padding stays small."""
    order, held = sorted(range(len(sizes)), key=sizes.__getitem__), []
    for k in order:
        if held and (len(held) + 1) * sizes[k] > CELLS // 10:
            yield held
            held = []
        held.append(k)
    if held:
        yield held


def train(parts: list[np.ndarray], good: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(weights, chain) of greatest penalised likelihood by Adam steps; classes weigh the same."""
    w, chain = np.zeros(N_FEATURES), np.zeros((2, 2))
    if len(set(good)) < 2:
        return w, chain
    share = {c: 0.5 / good.count(c) for c in (0, 1)}
    groups = []
    for at in _batches([len(p) for p in parts]):
        x, size = _padded([parts[k] for k in at])
        y = np.array([good[k] for k in at])
        groups.append((x, size, y, np.array([share[v] for v in y]) / np.maximum(size, 1)))
    m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for step in range(1, STEPS + LATENT + 1):
        g_w, g_chain = PENALTY * w, CHAIN_PENALTY * chain
        for x, size, y, weight in groups:
            emit = x @ w
            p, pairs = marginals(emit, size, chain)
            if step <= STEPS:
                q, seen = np.broadcast_to(y[:, None], p.shape), np.zeros_like(pairs)
                seen[np.arange(len(y)), y, y] = size - 1
            else:
                q, seen = marginals(emit + EVIDENCE * (2 * y - 1)[:, None], size, chain)
            live = np.arange(x.shape[1])[None, :] < size[:, None]
            g_w = g_w + np.einsum("dl,dlf->f", np.where(live, (p - q) * weight[:, None], 0), x)
            g_chain = g_chain + ((pairs - seen) * weight[:, None, None]).sum(0)
        g = np.concatenate([g_w, g_chain.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, chain = w - move[:N_FEATURES], chain - move[N_FEATURES:].reshape(2, 2)
    return w, chain


def scores(texts: list[str | None], w: np.ndarray, chain: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    held = [line_features(t) for t in texts]
    for at in _batches([len(f) for f, _ in held]):
        x, size = _padded([held[k][0] for k in at])
        p, _ = marginals(x @ w, size, chain)
        for row, k in enumerate(at):
            weight = held[k][1] + 1.0
            out[k] = float((p[row, : len(weight)] * weight).sum() / weight.sum())
    return np.clip(out, 0, 1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            f = line_features(batch.column("text")[k].as_py())[0]
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("quality")[k].as_py()], pa.int32()), pa.array([f.astype(np.float32).tobytes()], pa.binary())], ["quality", "f"])


def _scored(w: np.ndarray, chain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(part.column("text").to_pylist(), w, chain))], ["doc_id", "score"])

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN) -> tuple[np.ndarray, np.ndarray]:
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & ~held_out() & F.col("quality").isin(0, 1))
    order = F.xxhash64("doc_id", "quality")
    some = None
    for c in (0, 1):
        part = rows.where(F.col("quality") == c).orderBy(order, "doc_id").limit(per_class)
        some = part if some is None else some.unionAll(part)
    # at most 2 * per_class ids: a bounded broadcast; few features per document reach the driver
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some.select("doc_id").distinct()), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))  # a row an id, so at most 2 * per_class
    found = texts.join(F.broadcast(some), "doc_id").select("quality", "text").mapInArrow(_features, "quality int, f binary").collect()
    found.sort(key=lambda r: (r["quality"], bytes(r["f"])))
    parts = [np.frombuffer(r["f"], np.float32).reshape(-1, N_FEATURES).astype(np.float64) for r in found]
    return train(parts, [r["quality"] for r in found])


def score(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN) -> DataFrame:
    """(doc_id, score) of every document."""
    w, chain = fit(docs, labels, per_class)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(w, chain), "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: quality score of every document."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, labels)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
