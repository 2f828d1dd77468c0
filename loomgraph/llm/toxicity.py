"""Toxicity by subword bags: embeddings averaged into a linear softmax.

A word's features are itself and its character n-grams, hashed into buckets; a
document's vector is the mean of the embeddings of all its words' features, and a
softmax over it gives the classes. Embeddings and softmax are trained jointly, in
numpy, by full-batch Adam on a bounded sample of labelled documents (`SAMPLE` of
each class, the smallest md5 of the id). A misspelling that training never saw
shares most of its n-grams with the word it stands for, also one spelt with digits or
signs for letters, as these are read as the letters they look like.

The model is linear in the mean, so after training each bucket is one number, the
difference of its logits; scoring adds these over a text's words. The table is of
fixed size and goes to the executors with the task; a worker remembers the sums of
words it has met. Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import vectext
from loomgraph.llm.common import giving_back

BUCKETS, GRAMS, SIZE = 1 << 20, (3, 4, 5), 8
#: Labelled documents of each class, at most: toxic and not.
SAMPLE = (2500, 6000)
ROUNDS, RATE, SCALE, DECAY = 80, 0.1, 60.0, 0.01
#: A feature is learned if words that hold it are in so many sampled documents; a
#: tenth of the sample says when to stop.
LEAST, CHECK = 3, 10
#: Rounds without a better loss on that tenth before training ends.
PATIENCE = 20
#: Words whose features are worked out at once.
CHUNK = 50_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Digits and signs that stand for a letter inside a word, and one that
#: stands for any.
LOOKS, ANY = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}, "*"
_LOOK, _ENDS, _DIGITS = str.maketrans(LOOKS), "@$!*", "013457"
_SIGN = np.array([c < 128 and not chr(c).isalpha() and chr(c) not in LOOKS and chr(c) != ANY for c in range(256)])
_SPLIT = {c: " " for c in range(128) if _SIGN[c]} | _LOW


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' features, one word after another, and the offsets."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(length)
    room = np.repeat(ends, length) - np.arange(len(code))  # characters left in the word
    lead = vectext.mix64(code + np.uint64(1))
    owner = np.repeat(np.arange(len(words), dtype=np.int32), length)
    found, whose = [], []
    run = np.zeros(len(code), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        run = run * _ODD
        run[: len(code) - n + 1] += lead[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(room >= n)
            found.append((vectext.mix64(run[at] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32))
            whose.append(owner[at])
    # the word as a whole, if it is longer than the n-grams
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(length.max()), _ODD, np.uint64)]))
    place = np.arange(len(code)) - np.repeat(ends - length, length)
    whole = np.add.reduceat(lead * power[place], ends - length)
    found.append((vectext.mix64(whole + np.uint64(99)) % np.uint64(BUCKETS)).astype(np.int32))
    whose.append(np.arange(len(words), dtype=np.int32))
    bucket, whose = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return bucket[order], np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(words)))])


@dataclass
class Bag:
    """A sparse matrix by rows, and by columns for the gradient."""

    at: np.ndarray
    starts: np.ndarray
    value: np.ndarray
    width: int

    def __post_init__(self) -> None:
        rows = np.repeat(np.arange(len(self.starts) - 1, dtype=np.int32), np.diff(self.starts))
        order = np.argsort(self.at, kind="stable")
        self.back, self.back_value = rows[order], self.value[order]
        self.back_starts = np.concatenate([[0], np.cumsum(np.bincount(self.at, minlength=self.width))])

    @staticmethod
    def _times(at, starts, value, x) -> np.ndarray:
        out = np.zeros((len(starts) - 1, x.shape[1]), np.float32)
        step = 500_000
        first = 0
        while first < len(starts) - 1:  # so many entries at once
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + step, "right")) - 1)
            a, b = starts[first], starts[last]
            full = first + np.flatnonzero(np.diff(starts[first : last + 1]))
            if len(full):
                out[full] = np.add.reduceat(x[at[a:b]] * value[a:b, None], starts[full] - a)
            first = last
        return out

    def times(self, x: np.ndarray) -> np.ndarray:
        return self._times(self.at, self.starts, self.value, x)

    def back_times(self, x: np.ndarray) -> np.ndarray:
        return self._times(self.back, self.back_starts, self.back_value, x)


def raw_words(text: str) -> list[str]:
    """A text's runs of letters and of what may stand for one, A-Z lowered; some empty."""
    return text.translate(_SPLIT).split(" ")


def plain(word: str) -> str:
    """A run as a word: signs off its ends, digits off its end, and what stands for a
    letter as that letter, so 1d1ot is idiot; empty if no letter is in it."""
    word = word.strip(_ENDS).rstrip(_DIGITS + _ENDS)
    return word.translate(_LOOK) if any(c.isalpha() or c > "\x7f" for c in word) else ""


def train(texts: list[str] | list[dict[str, int]], labels: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """texts: whole, or their runs of letters and how often each occurs. The difference of logits of each bucket (NaN: not learned) and last the bias;
    with one class only, no features and an extreme bias."""
    labels = np.asarray(labels, np.int64)
    nothing = np.append(np.full(BUCKETS, np.nan), 0.0)
    if not len(labels) or labels.min() == labels.max():
        nothing[-1] = 50.0 if len(labels) and labels[0] else -50.0
        return nothing
    place: dict[str, int] = {}
    known: dict[str, int] = {"": -1}  # of each run its word's place
    at, starts, often = [], [0], []
    for text in texts:
        runs = text if isinstance(text, dict) else Counter(raw_words(text))
        for run in runs:
            if run not in known:
                word = plain(run)
                known[run] = place.setdefault(word, len(place)) if word else -1
        found, n = np.array([known[run] for run in runs], np.int32), np.fromiter(runs.values(), float, len(runs))
        words, which = np.unique(found[found >= 0], return_inverse=True)
        count = np.bincount(which, n[found >= 0], len(words))
        at.append(words)
        often.append(count)
        starts.append(starts[-1] + len(words))
    at, often, starts = np.concatenate(at), np.concatenate(often).astype(np.float32), np.array(starts)
    names, n_words = list(place), len(place)
    held_in = np.bincount(at, minlength=n_words)
    spread = np.zeros(BUCKETS)
    for first in range(0, n_words, CHUNK):
        bucket, bounds = features(names[first : first + CHUNK])
        spread += np.bincount(bucket, np.repeat(held_in[first : first + CHUNK], np.diff(bounds)), BUCKETS)
    used = np.flatnonzero(spread >= LEAST)
    if not len(used):
        return nothing
    number = np.full(BUCKETS, -1, np.int32)
    number[used] = np.arange(len(used))
    kept, per_word = [], []
    for first in range(0, n_words, CHUNK):
        bucket, bounds = features(names[first : first + CHUNK])
        bucket = number[bucket]
        per_word.append(np.add.reduceat((bucket >= 0).astype(np.int64), bounds[:-1]))
        kept.append(bucket[bucket >= 0])
    bucket, per_word = np.concatenate(kept), np.concatenate(per_word)
    del names, place, known, kept, spread
    row = np.repeat(np.arange(len(labels)), np.diff(starts))
    total = np.maximum(np.bincount(row, often * per_word[at], len(labels)), 1)
    # words of one document only count in the mean: their n-grams are learned from others
    shared = held_in >= 2
    bucket = bucket[np.repeat(shared, per_word)]
    bounds = np.concatenate([[0], np.cumsum(per_word[shared])])
    fresh = np.cumsum(shared) - 1
    inside = shared[at]
    at, row, often, n_words = fresh[at[inside]], row[inside], often[inside], int(shared.sum())
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(labels)))])
    docs = Bag(at, starts, (often / total[row]).astype(np.float32), n_words)
    words = Bag(bucket, bounds, np.ones(len(bucket), np.float32), len(used))

    rng = np.random.default_rng(5)
    p = {"e": rng.normal(0, 0.05, (len(used), SIZE)).astype(np.float32), "w": rng.normal(0, 0.5, (SIZE, 2)).astype(np.float32), "b": np.zeros(2, np.float32)}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    goal = np.eye(2, dtype=np.float32)[labels]
    held = np.arange(len(labels)) % CHECK == 0 if len(labels) >= 20 * CHECK else np.zeros(len(labels), bool)
    weight = (np.where(held, 0, 1) / max(1, (~held).sum())).astype(np.float32)[:, None]
    best, out, found = np.inf, nothing, 0
    for step in range(1, rounds + 1):
        mean = docs.times(words.times(p["e"])) * np.float32(SCALE)
        logit = mean @ p["w"] + p["b"]
        logit -= logit.max(axis=1, keepdims=True)
        soft = np.exp(logit)
        soft /= soft.sum(axis=1, keepdims=True)
        if held.any():
            loss = -np.log(np.maximum((soft * goal).sum(axis=1), 1e-7))[held].mean()
        else:
            loss = -step
        if loss < best and step > 10:
            best, out, found = loss, nothing.copy(), step
            out[used] = p["e"] @ (p["w"][:, 1] - p["w"][:, 0]) * SCALE
            out[-1] = p["b"][1] - p["b"][0]
        if held.any() and step > found + PATIENCE and step > 10 + PATIENCE:
            break
        off = (soft - goal) * weight
        grad = {"w": mean.T @ off, "b": off.sum(axis=0), "e": words.back_times(docs.back_times(off @ p["w"].T * np.float32(SCALE))) + np.float32(DECAY / len(labels)) * p["e"]}
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
            p[k] -= np.float32(RATE * min(1, 2 - 2 * step / (rounds + 1))) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return out


class Scorer:
    """Scores of texts, for one worker; remembers its words up to a bound."""

    REMEMBER = 2_000_000

    def __init__(self, table: np.ndarray):
        self.known = ~np.isnan(table[:-1])
        self.table, self.bias = np.where(self.known, table[:-1], 0), float(table[-1])
        self.forget()

    def forget(self) -> None:
        self.keys, self.sums, self.counts = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)

    def learn(self, data: np.ndarray, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        if len(self.keys) > self.REMEMBER:
            self.forget()
        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != hashes) if len(self.keys) else np.arange(len(hashes))
        if not len(new):
            return
        raw = data.tobytes()
        words = [plain(raw[a:b].decode("utf-8", "replace").translate(_LOW)) for a, b in zip(first[new].tolist(), last[new].tolist(), strict=True)]
        sums, counts = np.zeros(len(words)), np.zeros(len(words))  # runs without a letter count nothing
        real = np.array([bool(w) for w in words])
        if real.any():
            bucket, bounds = features([w for w in words if w])
            sums[real], counts[real] = np.add.reduceat(self.table[bucket], bounds[:-1]), np.add.reduceat(self.known[bucket].astype(float), bounds[:-1])
        keys = np.concatenate([self.keys, hashes[new]])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.sums, self.counts = np.concatenate([self.sums, sums])[order], np.concatenate([self.counts, counts])[order]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        hashes, bounds, starts, ends = vectext.words(data, offsets, _SIGN)
        n = len(offsets) - 1
        mean = np.zeros(n)
        if len(hashes):
            distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)
            self.learn(data, distinct, starts[example], ends[example])
            at = np.searchsorted(self.keys, distinct)
            sums, counts = (np.concatenate([[0], np.cumsum(x[at][which])])[bounds] for x in (self.sums, self.counts))
            mean = np.diff(sums) / np.maximum(np.diff(counts), 1)
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -60, 60)))


def _scoring(table: np.ndarray, out: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]):
    """out(batch, its scores) of each batch; a task remembers its words all along."""
    table = table.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(table)
        for batch in batches:
            data, offsets = vectext.packed(batch.column("text"))
            found = [own.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in vectext.blocks(offsets)]
            yield out(batch, np.concatenate(found) if found else np.zeros(0))

    return run


def _with_score(batch: pa.RecordBatch, score: np.ndarray) -> pa.RecordBatch:
    names = [c for c in batch.schema.names if c != "text"]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(score, pa.float64())], [*names, "score"])


def fold(column, folds: int = 5):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, held_out: int | None = 0, most: tuple[int, int] = SAMPLE) -> DataFrame:
    """order, text and toxic of the labelled documents to learn from, at most `most` of
    each class; of rows that share an id the text with the smallest md5."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where(fold("doc_id") != held_out) if held_out is not None else marked
    marked = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    picked = [marked.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(n) for k, n in ((1, most[0]), (0, most[1]))]
    picked = picked[0].union(picked[1])  # at most sum(most) rows: small enough to broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.select("doc_id", "toxic", F.struct(F.md5(F.col("text").cast("binary")).alias("m"), F.col("text")).alias("t"))
    return rows.groupBy("doc_id", "toxic").agg(F.min("t").alias("t")).select(order.alias("order"), F.col("t.text").alias("text"), "toxic")


def _wording(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as their different words, each as often as it occurs: what training needs of
    a text, however long it is."""
    for batch in batches:
        runs, counts = [], []
        for text in batch.column("text").to_pylist():
            found = Counter(raw_words(text))
            found.pop("", None)
            runs.append(list(found))
            counts.append(list(found.values()))
        yield pa.RecordBatch.from_arrays([batch.column("order"), pa.array(runs, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32())), batch.column("toxic")], ["order", "runs", "counts", "toxic"])


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    for batch in batches:
        texts += [dict(zip(r, c, strict=True)) for r, c in zip(batch.column("runs").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
        labels += batch.column("toxic").to_pylist()
    table = train(texts, np.array(labels, np.int64))
    at = np.flatnonzero(~np.isnan(table))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(table[at], pa.float64())], ["bucket", "weight"])


def learned(docs: DataFrame, labels: DataFrame, held_out: int | None = 0) -> np.ndarray:
    """The trained table. The sample, of bounded size, is trained on in one task, and
    only the buckets that were learned come to the driver."""
    words = sample(docs, labels, held_out).mapInArrow(_wording, "order string, runs array<string>, counts array<int>, toxic int")
    rows = words.repartition(1).sortWithinPartitions("order")
    found = rows.mapInArrow(giving_back(_training), "bucket int, weight double").toPandas()
    table = np.full(BUCKETS + 1, np.nan)
    table[found["bucket"]] = found["weight"]
    if np.isnan(table[-1]):  # no rows, no task
        table[-1] = -50.0
    return table


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Learns only from labelled documents whose crc32(doc_id as text) mod 5 is not 0.
    Null, empty and blank texts get the score of an empty mean, the bias. Labels
    that are null or of unknown documents are left out; of several for one id the
    largest counts. With one class only, all scores are near that class. Very long
    texts count whole; repeated rows get the same score. Extra columns are ignored; no
    rows in, no rows out.
    """
    table = learned(docs, labels)
    rows = docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "text")
    found = rows.mapInArrow(giving_back(_scoring(table, _with_score)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose score is the threshold or more.

    Learns from all labelled documents of docs. Null, empty and blank texts have the
    score of an empty mean; rows that repeat go or stay together; ids may be null or
    repeat; all columns come back, whatever their names. With labels of one class only
    all rows or none stay; without labels, all. No rows in, no rows out.
    """
    table = learned(docs, labels)
    return docs.mapInArrow(giving_back(_scoring(table, lambda batch, score: batch.filter(pa.array(score < threshold)))), docs.schema)
