"""Language-model scores by a weighted backoff automaton of order three.

The model. States are the root, every word that training has something after, the
start of a text, and every pair of neighbouring words of training (a text's start
counts as a word before it). A pair state (u, v) has an arc for each word w that
followed it, with log10 p(w | u v); a word state v likewise with log10 p(w | v);
the root has one for every word, known or not, with log10 p(w):

    p(w | u v) = (c(u v w) + K3 p(w | v)) / (c(u v) + K3)
    p(w | v)   = (c(v w) + K2 p(w)) / (c(v) + K2)
    p(w)       = (c(w) + 0.5) / (N + 0.5 (V + 1))

Where a state has no arc for a word, its failure arc leads to the state of one word
less, weight log10(K / (c + K)), which reads the word instead. So the probabilities
after a state, that of an unknown word included, sum to 1. An arc leads to the pair
state of its last two words if training has the pair, else to that of the word, else
to the root.

Traversal. All texts of a block are read from left to right at once, a word of each
at a step: every text carries its state and adds up the weights of the arcs it takes,
failure arcs included. Long texts are read in segments; the state that a segment
begins in is where its two words before lead, since no state remembers more.

Counting. The counts grow with the corpus, so they never sit in one place. Texts
become blocks of local word numbers, written once. Each block sends its different
words, pairs and triples, with its own training counts, to shards of hash ranges; a
shard sums them and answers each block with the totals, and the block builds the part
of the automaton that its own texts can reach. A block sends no empty message, so the
messages are never more than its entries, however many shards there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import vectext
from loomgraph.llm.common import Scratch, giving_back

#: What the model of one word less counts for, in words seen: after a word, after a pair
#: (chosen by held-out texts).
K2, K3 = 1000.0, 5.0
BLOCK_TOKENS, SHARD_ENTRIES, SEGMENT = 400_000, 2_000_000, 256
#: Bits that a hash has beyond those that number all entries.
SPARE_BITS = 20
START, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
#: The two lowest bits of an entry's hash: how many words it has; 0 is the start.
_KIND = np.uint64(3)


def held(x: np.ndarray) -> bytes:
    """An array as compressed bytes: its length, then each byte of the numbers in turn."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unheld(b: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(b[:8], "little")
    if not size:
        return np.zeros(0, kind)
    raw = pa.decompress(b[8:], size, "zstd", asbytes=True)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


class Grams:
    """The different words, pairs and triples of a block of texts.

    toks: each position's word (a place in vocab); ends: of the texts in toks; vocab:
    hashes of the words, then that of the start. A pair is (word before, word), the
    start before a text's first; a triple is (pair before, word)."""

    def __init__(self, vocab: np.ndarray, toks: np.ndarray, ends: np.ndarray):
        self.vocab, self.toks, self.ends = vocab, toks, ends
        self.begins = np.concatenate([[0], ends[:-1]])
        n = len(vocab)
        before = np.empty(len(toks), np.int64)
        before[1:] = toks[:-1]
        before[self.begins] = n - 1
        self.pairs, self.pair_at = np.unique(before * n + toks, return_inverse=True)
        self.inner = np.ones(len(toks), bool)
        self.inner[self.begins] = False
        at = np.flatnonzero(self.inner)
        self.triples, of = np.unique(self.pair_at[at - 1] * n + toks[at], return_inverse=True)
        self.triple_at = np.full(len(toks), len(self.triples))  # none at a text's first word
        self.triple_at[at] = of

    def hashes(self, bits: int) -> np.ndarray:
        """Of all entries: words and the start, pairs, triples; so many bits of the last two."""
        v, n = self.vocab, len(self.vocab)
        a, b = self.pairs // n, self.pairs % n
        u, w = self.triples // n, self.triples % n
        out = [vectext.mix64(v), vectext.combine([v[a], v[b]]), vectext.combine([v[a[u]], v[b[u]], v[w]])]
        kinds = [np.append(np.ones(n - 1, np.uint64), np.uint64(0)), np.full(len(a), 2, np.uint64), np.full(len(u), 3, np.uint64)]
        cut = ~np.uint64((1 << 64 - bits) - 1)
        return np.concatenate([(h & ~_KIND & (cut if i else ~_KIND)) | k for i, (h, k) in enumerate(zip(out, kinds, strict=True))])

    def counts(self, train: np.ndarray) -> np.ndarray:
        """Of all entries, in the training texts."""
        seen = np.repeat(train, np.diff(self.ends, prepend=0))
        words = np.bincount(self.toks[seen], minlength=len(self.vocab))
        words[-1] = train.sum()
        return np.concatenate([words, np.bincount(self.pair_at[seen], minlength=len(self.pairs)), np.bincount(self.triple_at[seen & self.inner], minlength=len(self.triples))])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as blocks: vocab (hashes, the most frequent first, and the start), toks
    (places in vocab, each text's end included), ends (of the texts in toks)."""
    task, made = TaskContext.get().partitionId(), 0
    ids: list = []
    trains: list[bool] = []
    words: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    n = 0

    def out() -> pa.RecordBatch:
        nonlocal ids, trains, words, sizes, n, made
        flat, size, train = np.concatenate(words), np.concatenate(sizes), np.array(trains)
        ends = np.cumsum(size + 1)
        vocab, toks = np.unique(np.insert(flat, np.cumsum(size), END), return_inverse=True)
        order = np.argsort(-np.bincount(toks), kind="stable")
        place = np.empty(len(vocab), np.int64)
        place[order] = np.arange(len(vocab))
        toks, vocab = place[toks], np.append(vocab[order], START)
        entries = len(vocab) + int(2 * len(toks))
        row = [pa.array([task << 32 | made]), pa.array([ids], pa.list_(pa.int64())), *[pa.array([held(x)], pa.binary()) for x in (train.view(np.uint8), ends, vocab, toks.astype(np.uint32))], pa.array([entries])]
        ids, trains, words, sizes, n, made = [], [], [], [], 0, made + 1
        return pa.RecordBatch.from_arrays(row, ["block", "doc_ids", "train", "ends", "vocab", "toks", "entries"])

    for batch in batches:
        data, offsets = vectext.packed(batch.column("text"))
        names, train = batch.column("doc_id").to_pylist(), batch.column("train").to_pylist()
        for a, b in vectext.blocks(offsets):
            found, bounds = vectext.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            words.append(found)
            sizes.append(np.diff(bounds))
            ids += names[a:b]
            trains += train[a:b]
            n += len(found) + b - a
            if n >= BLOCK_TOKENS:
                yield out()
    if ids:
        yield out()


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _groups(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[tuple]]:
    """Rows that follow one another with the same first column."""
    group: list[tuple] = []
    for row in _rows(batches, *names):
        if group and group[0][0] != row[0]:
            yield group
            group = []
        group.append(row)
    if group:
        yield group


def _block(row: tuple) -> tuple[Grams, np.ndarray]:
    """The grams of a block's row (train, ends, vocab, toks), and its training texts."""
    train, ends, vocab, toks = row
    return Grams(unheld(vocab, "u8"), unheld(toks, "u4").astype(np.int64), unheld(ends, "i8")), unheld(train, "u1").astype(bool)


ASK = "shard int, block long, words binary, hashes binary, counts binary"


def _sent(hashes: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Ordered hashes as differences: single words (and the start) by themselves, as they
    have more bits."""
    one, own = (hashes & _KIND) < 2, np.uint64(64 - bits)
    more = hashes[~one]
    short = ((more >> own) << np.uint64(1)) | (more & np.uint64(1))  # a pair or a triple
    return held(np.diff(hashes[one], prepend=np.uint64(0))), held(np.diff(short, prepend=np.uint64(0)))


def _received(words: bytes, more: bytes, bits: int) -> np.ndarray:
    """What _sent was given, in the order of the whole."""
    one, short = (np.cumsum(unheld(b, "u8"), dtype=np.uint64) for b in (words, more))
    back = ((short >> np.uint64(1)) << np.uint64(64 - bits)) | (short & np.uint64(1)) | np.uint64(2)
    return np.sort(np.concatenate([one, back]))


def _asking(shards: int, bits: int):
    """A block's entries in order of hash, cut where the shards' ranges of it begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, *row in _rows(batches, "block", "train", "ends", "vocab", "toks"):
            grams, train = _block(tuple(row))
            hashes, counts = grams.hashes(bits), grams.counts(train).astype(np.uint32)
            order = np.argsort(hashes)
            hashes, counts = hashes[order], counts[order]
            shard = ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            starts = np.flatnonzero(np.diff(shard, prepend=-1))
            ends = np.append(starts[1:], len(shard))
            parts = [(*_sent(hashes[a:b], bits), held(counts[a:b])) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            columns = [pa.array(shard[starts], pa.int32()), pa.array([block] * len(starts), pa.int64()), *[pa.array(c, pa.binary()) for c in zip(*parts, strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "words", "hashes", "counts"])

    return run


ANSWER = "block long, shard int, width int, totals binary"


def _answering(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "shard", "block", "words", "hashes", "counts"):
            yield from _answers(group, bits)

    return run


def _answers(group: list[tuple], bits: int) -> Iterator[pa.RecordBatch]:
    """The totals of a shard's entries for each block that asked; and, as block -1, the
    training tokens and the different training words of the shard's range."""
    shard, parts = group[0][0], [_received(r[2], r[3], bits) for r in group]
    hashes, counts = np.concatenate(parts), np.concatenate([unheld(r[4], "u4") for r in group])
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    starts = np.flatnonzero(new)
    total = np.add.reduceat(counts[order].astype(np.uint64), starts)
    words = total[(hashes[starts] & _KIND) == 1]
    yield _answer(-1, shard, np.array([words.sum(), (words > 0).sum()], np.uint64))
    answer = np.empty(len(order), np.uint64)
    answer[order] = total[np.cumsum(new) - 1]
    del hashes, counts, order, new
    at = 0
    for row, part in zip(group, parts, strict=True):
        yield _answer(row[1], shard, answer[at : at + len(part)])
        at += len(part)


def _answer(block: int, shard: int, totals: np.ndarray) -> pa.RecordBatch:
    least = np.min_scalar_type(totals.max()) if len(totals) else np.dtype(np.uint8)
    totals = totals.astype(least)
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([shard], pa.int32()), pa.array([totals.itemsize], pa.int32()), pa.array([held(totals)], pa.binary())], ["block", "shard", "width", "totals"])


class Automaton:
    """The part of the automaton that a block's texts can reach.

    States: 0 is the root, 1 + w the word w (the start is the last), then the pairs. A
    word state's arc on a word is that of the pair the two make, a pair state's that of
    the triple; so arcs are numbered as pairs and triples are."""

    def __init__(self, grams: Grams, total: np.ndarray, tokens: int, types: int):
        self.grams, n, p = grams, len(grams.vocab), len(grams.pairs)
        one, two, three = total[:n], total[n : n + p], total[n + p :]
        a, b = grams.pairs // n, grams.pairs % n
        u, w = grams.triples // n, grams.triples % n
        root = (one + 0.5) / (tokens + 0.5 * (types + 1))
        after_word = (two + K2 * root[b]) / (one[a] + K2)
        last = np.searchsorted(grams.pairs, b[u] * n + w)  # the pair that a triple ends in
        after_pair = (three + K3 * after_word[last]) / (two[u] + K3)
        self.weights = np.log10(root), np.log10(after_word), np.append(np.log10(after_pair), 0.0)
        to_word = np.where(one > 0, 1 + np.arange(n), 0)
        to_pair = np.where(two > 0, 1 + n + np.arange(p), to_word[b])
        self.to = to_word, to_pair, np.append(to_pair[last], 0)
        #: Whether training has the arc; the root has all.
        self.arc = two > 0, np.append(three > 0, False)
        self.fail = np.log10(np.concatenate([[1.0], K2 / (one + K2), K3 / (two + K3)]))
        self.fail_to = np.concatenate([np.zeros(1 + n, np.int64), to_word[b]])
        self.start = n if one[-1] > 0 else 0

    def step(self, state: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each state goes on the word at its place, and the weight of the arcs it
        takes: its own if it has one for the word, else its failure arc and so on."""
        grams, gain, to = self.grams, np.zeros(len(state)), np.zeros(len(state), np.int64)
        reading = np.ones(len(state), bool)
        for order, number in ((2, grams.triple_at), (1, grams.pair_at), (0, grams.toks)):
            which = number[at]
            here = reading & (state > (0, 0, len(grams.vocab))[order]) if order else reading
            takes = here & self.arc[order - 1][which] if order else here
            gain += np.where(takes, self.weights[order][which], np.where(here, self.fail[state], 0.0))
            to = np.where(takes, self.to[order][which], to)
            state = np.where(here, self.fail_to[state], state)
            reading = reading & ~takes
        return to, gain

    def walk(self) -> np.ndarray:
        """Each text's sum of weights."""
        grams = self.grams
        sizes = grams.ends - grams.begins
        cuts = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(sizes)), cuts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        warm = np.where(number > 0, 2, 0)  # words read only to find the state
        first = grams.begins[text] + number * SEGMENT - warm
        length = np.minimum(SEGMENT, sizes[text] - number * SEGMENT) + warm
        order = np.argsort(-length, kind="stable")
        text, first, length, warm = text[order], first[order], length[order], warm[order]
        # a text begins at the start's state, a segment's two words are read from the root
        state = np.where(warm > 0, 0, self.start)
        score = np.zeros(len(text))
        for t in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -t, "left"))
            state[:live], gain = self.step(state[:live], first[:live] + t)
            score[:live] += np.where(t >= warm[:live], gain, 0.0)
        return np.bincount(text, score, len(sizes))


def _scoring(tokens: int, types: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "block", "shard", "doc_ids", "train", "ends", "vocab", "toks", "width", "totals"):
            _, _, ids, *row, _, _ = group[0]
            grams, train = _block(tuple(row))
            total = np.empty(len(grams.vocab) + len(grams.pairs) + len(grams.triples))
            total[np.argsort(grams.hashes(bits))] = np.concatenate([unheld(r[8], f"u{r[7]}") for r in group[1:]])
            automaton = Automaton(grams, total, tokens, types)
            known = np.add.reduceat((total[grams.toks] > 0).astype(np.int64), grams.begins)
            plain = np.add.reduceat(automaton.weights[0][grams.toks], grams.begins)
            score = automaton.walk()
            out = [pa.array(ids, pa.int64()), pa.array(~train), pa.array(grams.ends - grams.begins), pa.array(known), pa.array(np.full(len(ids), tokens)), pa.array(plain), pa.array(score)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _dealt(rows: DataFrame, n: int, run: Callable, schema: str, key: str, *order: str) -> DataFrame:
    """Groups of key, of which there are n, dealt to as many tasks."""
    return rows.repartition(n, key).sortWithinPartitions(key, *order).mapInArrow(giving_back(run), schema)


def scores(docs: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (see the module's text).

    Trained on the rows whose crc32(doc_id as text) mod `folds` is not `fold` (a null
    id counts as the empty text). Null and empty texts are one token, the end; a very
    long text makes a block by itself and is read in segments. With nothing to train
    on, every token is unknown. Repeated rows count and are scored each on their own.
    Extra columns are ignored; no rows in, no rows out.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.crc32(id_text) % folds != fold).alias("train"))
    made = "block long, doc_ids array<long>, train binary, ends binary, vocab binary, toks binary, entries long"
    blocks = scratch.table(rows.mapInArrow(giving_back(_blocks), made), "blocks")
    entries, n_blocks = blocks.agg(F.sum("entries"), F.greatest(F.count(F.lit(1)), F.lit(1))).first()
    shards = max(1, -(-(entries or 0) // SHARD_ENTRIES))
    bits = min(62, max(48, (entries or 1).bit_length() + SPARE_BITS))
    asked = blocks.select("block", "train", "ends", "vocab", "toks").mapInArrow(giving_back(_asking(shards, bits)), ASK)
    answers = scratch.table(_dealt(asked, shards, _answering(bits), ANSWER, "shard", "block"), "answers")
    sums = answers.where("block = -1").select("width", "totals").mapInArrow(_totals, "tokens long, types long").agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = (int(x or 0) for x in sums)
    whole = blocks.drop("entries").withColumn("shard", F.lit(-1)).unionByName(answers.where("block >= 0"), allowMissingColumns=True)
    return _dealt(whole, n_blocks, _scoring(tokens, types, bits), SCORES, "block", "shard")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [unheld(b, f"u{w}") for w, b in zip(batch.column("width").to_pylist(), batch.column("totals").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([int(b[i]) for b in both], pa.int64()) for i in (0, 1)], ["tokens", "types"])
