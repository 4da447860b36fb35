"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (in ``<word>``) and itself, hashed into a
table of embeddings; its vector is their mean, a text's vector the mean of its words'.
Two softmax outputs are trained jointly with the embeddings by gradient steps in
numpy, so a misspelling never seen shares most of its n-grams with what was seen.
For scoring the product of each embedding with the output weights is one number per
bucket, and a text's logit the mean of its words' numbers: one pass, no shuffle.

The fit uses at most ``MAX_FIT`` labelled rows, those of the smallest row hash; all
else sees every row, repeated ones too, and whole texts, however long. Columns beside
``doc_id`` and ``text`` are not read, whatever their names; ``keep_clean`` returns them as
they are. Null and empty texts, and texts without words, get the score of
the bias alone. Null labels are no labels; a document labelled both ways is toxic.
Without labels of both kinds the score is the share of toxic ones (0 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.batches import per_slice, slices

#: Labelled rows that a fit reads at most.
MAX_FIT = 4096
BUCKETS = 1 << 16
DIMENSIONS = 4
#: Training texts that must hold a bucket for it to have a value.
LEAST_DOCUMENTS = 3
NGRAMS = (3, 4, 5)
EPOCHS = 8
#: Steps that a fit on few rows makes all the same.
LEAST_STEPS = 120
BATCH = 128
RATE = 0.05
#: Weight of the penalty against all rows together: few rows are fitted less closely.
DECAY = 0.12
CACHE_ENTRIES = 150_000
_LONGEST = 40  # bytes of a word that its n-grams are taken from; longer ones fall apart into such parts

#: Lower-cases A-Z and turns ASCII characters that are neither letters nor digits into spaces.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    words = text.encode().translate(_FOLD).split()
    if any(len(w) > _LONGEST for w in words):
        words = [w[i : i + _LONGEST] for w in words for i in range(0, len(w), _LONGEST)]
    return words


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of each word, and the word it belongs to."""
    marked = b"".join([b"<" + w + b">" for w in words])
    byte = np.frombuffer(marked, np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), lengths)
    ends = np.cumsum(lengths)
    left = ends[word] - np.arange(len(byte))  # bytes from here to the end of the word
    buckets, owners = [], []
    h, mult = np.zeros(len(byte), np.uint64), np.uint64(0x100000001B3)
    for n in range(1, max(NGRAMS) + 1):
        h = h[: len(byte) - n + 1] * mult ^ byte[n - 1 :]
        if n in NGRAMS:
            ok = np.flatnonzero(left[: len(h)] >= n)
            buckets.append(h[ok] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))
            owners.append(word[ok])
    # the word itself: a sum over its bytes of position-dependent products
    at = np.arange(len(byte)) - (ends - lengths)[word]
    whole = np.add.reduceat(
        (byte + np.uint64(1)) * (at.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(0x2545F4914F6CDD1D)),
        ends - lengths,
    )
    buckets.append((whole ^ whole >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15))
    owners.append(np.arange(len(words)))
    return (np.concatenate(buckets) >> np.uint64(48)).astype(np.int64), np.concatenate(owners)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights, which sum to 1."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    index: dict[bytes, int] = {}
    count = np.bincount([index.setdefault(w, len(index)) for w in words])
    buckets, owner = subwords(list(index))
    weight = (count / np.bincount(owner) / len(words))[owner]
    total = np.bincount(buckets, weight, BUCKETS)
    used = np.flatnonzero(total)
    return used.astype(np.int32), total[used].astype(np.float32)


@dataclass
class Model:
    """Score of a text: logistic of ``bias`` plus the mean over words of the mean over n-grams of ``value``."""

    value: np.ndarray
    bias: float


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Model:
    """Embeddings and softmax weights together, by Adam over mini-batches."""
    y = np.asarray(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    # what fewer than LEAST_DOCUMENTS texts hold is noise; it keeps the value 0
    holders = np.zeros(BUCKETS, np.int64)
    for b, _ in bags:
        holders[b] += 1
    seen = holders >= LEAST_DOCUMENTS
    # in place: a bag as it came and as it is used are never all there at once
    for i, (b, w) in enumerate(bags):
        bags[i] = (b[seen[b]], w[seen[b]])
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    share = y.mean()
    bias = np.log(np.array([1 - share, share], np.float32))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, out, bias)]
    scale, step = np.float32(30.0), 0  # means over texts are small: steps on the scaled mean are not
    lengths = np.array([len(b[0]) for b in bags])
    epochs = max(EPOCHS, -(-LEAST_STEPS // -(-len(y) // BATCH)))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / epochs) + RATE * 0.02
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            index = np.concatenate([bags[r][0] for r in rows])
            weight = np.concatenate([bags[r][1] for r in rows]) * scale
            owner = np.repeat(np.arange(len(rows)), lengths[rows])
            used, back = np.unique(index, return_inverse=True)
            part = table[used]
            mean = np.stack([np.bincount(owner, part[back, d] * weight, len(rows)) for d in range(DIMENSIONS)], 1)
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            down = (p @ out.T).astype(np.float32)
            grad = np.stack([np.bincount(back, down[owner, d] * weight, len(used)) for d in range(DIMENSIONS)], 1)
            step += 1
            for param, g, (m, v), at in (
                (table, grad + DECAY / len(y) * part, moments[0], used),
                (out, mean.T @ p + 1e-5 * out, moments[1], slice(None)),
                (bias, p.sum(0), moments[2], slice(None)),
            ):
                m[at] = 0.9 * m[at] + 0.1 * g
                v[at] = 0.99 * v[at] + 0.01 * g * g
                size = rate / (1 - 0.9**step)
                param[at] -= size * m[at] / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-8)
    table[~seen] = 0
    return Model((table @ (out[:, 1] - out[:, 0]) * scale).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Scores in a task; words met before keep their number."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, float] = {}

    def _learn(self, words: set[bytes]) -> dict[bytes, float]:
        new = list(words)
        buckets, owner = subwords(new)
        value = np.bincount(owner, self.model.value[buckets]) / np.bincount(owner)
        found = dict(zip(new, value.tolist()))
        if len(self.known) + len(found) <= CACHE_ENTRIES:
            self.known.update(found)
        return found

    def scores(self, texts: list[str]) -> np.ndarray:
        words = [words_of(t) for t in texts]
        got = [list(map(self.known.get, w)) for w in words]
        missing = {x for w, g in zip(words, got) if None in g for x, y in zip(w, g) if y is None}
        new = self._learn(missing) if missing else {}
        mean = np.zeros(len(texts))
        for i, (w, g) in enumerate(zip(words, got)):
            if None in g:
                g = [new[x] if y is None else y for x, y in zip(w, g)]
            if g:
                mean[i] = sum(g) / len(g)
        return 1 / (1 + np.exp(-np.clip(mean + self.model.bias, -60, 60)))


def held_out(doc_id) -> F.Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT) -> Model:
    """Fit on the bags of at most ``max_rows`` labelled documents outside the held-out fifth.

    What reaches the driver is bounded: ``max_rows`` bags of at most ``BUCKETS`` pairs of 6 bytes.
    """
    known = (
        labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .where(~held_out("doc_id"))
    )
    # the rows to learn from are chosen by id before any text is moved; ids in no document take no place
    ids = docs.select("doc_id").distinct()
    chosen = known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows small rows

    def bags(batches):
        for part, strings in slices(batches):
            made = [bag(t) for t in strings]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "toxic": part.column("toxic"),
                    "buckets": pa.array([b.astype("<u2").tobytes() for b, _ in made], pa.binary()),
                    "weights": pa.array([w.astype("<f4").tobytes() for _, w in made], pa.binary()),
                }
            )

    made = texts.mapInArrow(bags, "doc_id bigint, toxic int, buckets binary, weights binary")
    # repeated rows of one document count once
    rows = made.dropDuplicates(["doc_id"]).toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy())
    toxic = rows.column("toxic").to_numpy()[order]
    pairs = [
        (np.frombuffer(rows.column("buckets")[i].as_py(), "<u2"), np.frombuffer(rows.column("weights")[i].as_py(), "<f4"))
        for i in order.tolist()
    ]
    del rows
    return fit(pairs, toxic)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row."""
    held: dict[str, Scorer] = {}

    def work(part, texts):
        scorer = held.setdefault("scorer", Scorer(model))
        return {"doc_id": part.column("doc_id"), "score": pa.array(scorer.scores(texts), pa.float64())}

    scored = per_slice(docs.select("doc_id", "text"), work, "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows, all columns as they are, whose score is below ``threshold``."""
    held: dict[str, Scorer] = {}

    def run(batches):
        scorer = held.setdefault("scorer", Scorer(model))
        for part, texts in slices(batches):
            yield part.filter(pa.array(scorer.scores(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
