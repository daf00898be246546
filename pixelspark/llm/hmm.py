"""Hidden Markov language model.

Tokens are a text's words and one end. Every training word has emissions of its own. Latent states are trained by Baum-Welch over all training texts: every task
sums its expected counts by word and state, and the sums are added across partitions. Those of the ``KNOWN`` most frequent words reach the driver and go to every task;
those of all rarer words stay a distributed table. Texts form blocks of about ``TOGETHER`` tokens when their words are numbered; a rare word has a place in each block that holds it, and belongs to
a bucket of words. The places of a block in a bucket form a tile, one row of packed bytes, which goes to the block and back to the bucket in each round. Each word's counts get one token, shared among the states as all tokens
are, so that the states' mean is (c + 1) / (N + V + 1). Only a word never seen in training is smoothed by a class, named by a hash of its last two bytes: it has 1 / (N + V + 1), weighted by
how far the state's share of its class exceeds the state's share of all tokens. The score of a text is its exact log10 likelihood by the scaled forward recursion.

Counts of all words stay distributed as well. Sequences run together, longest first, so that a step of the recursion is one product of small matrices for all of them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, words

SHARED, KNOWN, STATES, ROUNDS = 64, 200_000, 8, 3
#: Different disturbances that words start with.
STARTS = 4096
#: Tokens that a task works on together.
TOGETHER = 1_000_000
#: The end token; no word is empty.
END = b""


def held_out_rows(id_col, folds: int = 7, fold: int = 2):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _shared_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SHARED


def token_counts(docs: DataFrame) -> DataFrame:
    """``docs(text)`` -> ``(word, c)``, the end token among them; summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                seen.update(words(text.as_py()))
                seen[END] += 1
                if len(seen) > 500_000:
                    yield flush()
        if seen:
            yield flush()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The end token, which every text needs, and the most frequent words, with their numbers, counts and log10(c + 1)."""

    def __init__(self, top: list[tuple[bytes, int]]):
        self.words = [w for w, _ in top]
        self.number = {w: i for i, w in enumerate(self.words)}
        self.counts = np.array([c for _, c in top], np.float64)
        self.log = np.log10(self.counts + 1)

    def numbers(self) -> Numbers:
        return Numbers(self.number)


class Numbers(dict):
    """The numbers of known words; other words get the next ones as they are asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _squeezed(symbols: np.ndarray) -> bytes:
    """Lower halves, then upper halves, which are mostly zeros."""
    return pa.compress(symbols.astype("<u4").view("<u2").reshape(-1, 2).T.tobytes(), codec="zstd", asbytes=True)


def _symbols(data: bytes, n: int) -> np.ndarray:
    low, high = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd"), "<u2").reshape(2, -1)
    return low.astype(np.int64) + (high.astype(np.int64) << 16)


def code_texts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs(doc_id, held_out, text)`` -> the same without text, with ``block, n_tokens, n_known, log_known, symbols``; and for each block a row more whose ``rare`` has the block's unknown words
    by their places. The texts of a block with an odd number are held out, no others are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, known = TaskContext.get().partitionId() << 32, len(vocabulary.words)
        begun: dict[bool, list] = {}  # block, numbers, tokens
        names = ["block", "held_out", "doc_id", "n_tokens", "n_known", "log_known", "symbols", "rare"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
        counts, logs = np.append(vocabulary.counts > 0, False), np.append(vocabulary.log, 0.0)

        def made(columns: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def ended(held_out: bool) -> pa.RecordBatch:
            block, numbers, _ = begun.pop(held_out)
            return made([[block], [held_out], *([None] for _ in range(5)), [list(islice(numbers, known, None))]])

        for batch in batches:
            for held_out in (False, True):
                some = batch.filter(pa.compute.equal(batch.column("held_out"), held_out))
                for at in range(0, len(some), 100):
                    part = some.slice(at, 100)
                    if held_out not in begun:
                        begun[held_out], blocks = [2 * blocks + held_out, vocabulary.numbers(), 0], blocks + 1
                    here = begun[held_out]
                    tokens = [[*words(t), END] for t in part.column("text").to_pylist()]
                    sizes = np.array([len(t) for t in tokens])
                    symbols = np.fromiter(map(here[1].__getitem__, chain.from_iterable(tokens)), np.int64, sizes.sum())
                    ends, of = np.cumsum(sizes), np.minimum(symbols, known)
                    columns = [[here[0]] * len(part), part.column("held_out"), part.column("doc_id"), sizes, np.add.reduceat(counts[of], ends - sizes, dtype=np.int64), np.add.reduceat(logs[of], ends - sizes)]
                    yield made([*columns, [_squeezed(x) for x in np.split(symbols, ends[:-1])], [None] * len(part)])
                    here[2] += int(ends[-1])
                    if here[2] >= TOGETHER:
                        yield ended(held_out)
        for held_out in list(begun):
            yield ended(held_out)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "block long, held_out boolean, doc_id long, n_tokens long, n_known long, log_known double, symbols binary, rare array<binary>")


class Packed:
    """Sequences laid out step by step, longest first: step t is the first ``active[t]`` sequences' t-th symbols."""

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences])
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        flat = np.concatenate([sequences[i] for i in self.order]).astype(np.int64)
        step = np.concatenate([np.arange(n) for n in sizes])
        who = np.repeat(np.arange(len(sizes)), sizes)
        self.active = np.bincount(step)
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        at = self.offset[step] + who
        self.symbol = np.empty(len(flat), np.int64)
        self.symbol[at] = flat
        self.who = np.empty(len(flat), np.int64)
        self.who[at] = who
        self.n = len(sizes)


class Hmm:
    """Start and transition probabilities and, for each symbol, its probability in every state."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def forward(self, p: Packed, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward probabilities and scales at each place; log10 likelihood of each sequence in the given order. Scores take doubles, expected counts single precision."""
        emit, move = np.take(self.emit.astype(kind, copy=False), p.symbol, axis=0), self.move.astype(kind)
        scale = np.empty(len(p.symbol), kind)
        alpha = emit  # overwritten step by step
        for t, n in enumerate(p.active.tolist()):
            a, b = int(p.offset[t]), int(p.offset[t]) + n
            now = alpha[a:b]
            now *= self.start.astype(kind) if t == 0 else alpha[last : last + n] @ move
            s = now.sum(axis=1)
            scale[a:b] = s
            now /= s[:, None]
            last = a
        likelihood = np.empty(p.n)
        likelihood[p.order] = np.bincount(p.who, np.log10(scale.astype(np.float64)), p.n)
        return alpha, scale, likelihood

    def expected(self, p: Packed, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions of the sequences."""
        kind, active, offset = np.float32, p.active.tolist(), p.offset.tolist()
        start, move = self.start.astype(kind), self.move.astype(kind)
        back, ones = np.ascontiguousarray(move.T), np.ones((len(move), 1), kind)
        weight = np.take(self.emit.astype(kind, copy=False), p.symbol, axis=0)  # becomes emission * beta / scale
        alpha, beta, scale = np.empty_like(weight), np.ones_like(weight), np.empty((len(weight), 1), kind)
        for t, n in enumerate(active):
            a, b = offset[t], offset[t] + n
            now = alpha[a:b]
            if t:
                np.matmul(alpha[last : last + n], move, out=now)
                now *= weight[a:b]
            else:
                np.multiply(weight[a:b], start, out=now)
            np.matmul(now, ones, out=scale[a:b])
            now /= scale[a:b]
            last = a
        weight /= scale
        for t in range(len(active) - 1, 0, -1):
            a, n, before = offset[t], active[t], offset[t - 1]
            now = weight[a : a + n]
            now *= beta[a : a + n]
            np.matmul(now, back, out=beta[before : before + n])
        first = active[0]
        previous = np.repeat(p.offset[:-2] - p.offset[1:-1], p.active[1:]) + np.arange(first, len(p.symbol)) if len(active) > 1 else np.empty(0, np.int64)
        moves = np.zeros(move.shape)
        for at in range(0, len(previous), 1 << 17):
            some = previous[at : at + (1 << 17)]
            moves += np.take(alpha, some, axis=0).T @ weight[first + at : first + at + len(some)]
        alpha *= beta  # the probability of each state
        emits = np.stack([np.bincount(p.symbol, alpha[:, k], symbols) for k in range(alpha.shape[1])], axis=1)
        return alpha[:first].sum(axis=0, dtype=np.float64), self.move * moves, emits


class Emissions:
    """What turns a word's summed counts by state into its emissions, and the emissions of words never seen."""

    def __init__(self, by_class: np.ndarray, distinct: int):
        """by_class: expected counts of all training words by the class of their last bytes and state."""
        states = by_class.sum(axis=0)
        n = states.sum()
        self.share = (states + 1 / len(states)) / (n + 1)
        self.norm = states + self.share * (distinct + 1)
        lift = (by_class + self.share) / (by_class.sum(axis=1, keepdims=True) + 1) / self.share
        self.unseen = lift / (n + distinct + 1)

    def of(self, counts: np.ndarray) -> np.ndarray:
        return (counts + self.share) / self.norm

    def of_places(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Negative ids mark words never seen, and their classes."""
        out = self.of(counts)
        unseen = ids < 0
        out[unseen] = self.unseen[-1 - ids[unseen]]
        return out


def _first_shares(states: int, seed: int = 0) -> np.ndarray:
    g = np.random.default_rng(seed).gamma(2.0, 1.0, (STARTS, states))
    return g / g.sum(axis=1, keepdims=True)


TILES = "block long, bucket int, slots binary, ids binary, c binary, counts binary"
#: Known words whose sums share a row.
SHELF = 256


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _counts_of(tiles: pa.Table, states: int) -> np.ndarray:
    """Counts by place and state; of tiles without counts they are 0."""
    sizes = pyarrow.compute.binary_length(tiles.column("slots")).to_pylist()
    data = [bytes(n * states) if x is None else x for x, n in zip(tiles.column("counts").to_pylist(), sizes, strict=True)]
    return np.frombuffer(b"".join(data), "<f4").reshape(-1, states)


def _with_counts(tiles: pa.Table, counts: np.ndarray) -> pa.RecordBatch:
    """The tiles with the counts of their places, one after another, in single precision; a row without places is a shelf."""
    tiles = tiles.combine_chunks()
    sizes = pyarrow.compute.fill_null(pyarrow.compute.binary_length(tiles.column("slots")), 4 * SHELF).to_numpy() // 4
    data = pa.array([x.astype("<f4").tobytes() for x in np.split(counts, np.cumsum(sizes)[:-1])], pa.binary())
    return pa.record_batch([*(c.chunk(0) for c in tiles.columns), data], names=[*tiles.column_names, "counts"])


def _edges(keys: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return list(zip(edges, edges[1:], strict=False))


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows in the order of ``key``, in tables that end where a batch's last key begins, or where the rows end; no key is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if len(batch):
            keys = batch.column(key).to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if held and (cut or held[-1].column(key)[-1].as_py() != keys[-1]):
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield pa.Table.from_batches([batch.slice(0, cut)])
            held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _blocks(batches: Iterator[pa.RecordBatch], states: int) -> Iterator[tuple[pa.Table, list[np.ndarray], pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block its texts, their symbols, its tiles, their places; and the ids, counts in training and counts by state of its rare words, by place."""
    for run in _runs(batches, "block"):
        for a, b in _edges(run.column("block").to_numpy()):
            table = run.slice(a, b - a)
            n = len(table) - table.column("symbols").null_count  # texts have no bucket and come first
            texts, tiles = table.slice(0, n), table.slice(n).select(["block", "bucket", "slots", "ids", "c", "counts"])
            sequences = [_symbols(x, k) for x, k in zip(texts.column("symbols").to_pylist(), texts.column("n_tokens").to_pylist(), strict=True)]
            slots = _joined(tiles.column("slots"), "<i4")
            ids, c, counts = np.empty(len(slots), np.int64), np.empty(len(slots), np.int64), np.empty((len(slots), states))
            ids[slots], c[slots], counts[slots] = _joined(tiles.column("ids"), "<i8"), _joined(tiles.column("c"), "<i8"), _counts_of(tiles, states)
            yield texts, sequences, tiles, slots, ids, c, counts


def _at_blocks(texts: DataFrame, tiles: DataFrame, tasks: int) -> DataFrame:
    """Texts and tiles of a block together."""
    return texts.unionByName(tiles, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "bucket").coalesce(tasks)


def _added(batches: Iterator[pa.RecordBatch], states: int) -> Iterator[pa.RecordBatch]:
    """Tiles in the order of bucket and block -> the same, each place with its id's sums; of buckets below 0, whose rows hold a shelf of known words each, one row."""
    for run in _runs(batches, "bucket"):
        below = int(np.searchsorted(run.column("bucket").to_numpy(), 0))
        if below:
            part = run.slice(0, below)
            at = np.array([a for a, _ in _edges(part.column("bucket").to_numpy())])
            sums = np.add.reduceat(_joined(part.column("counts"), "<f4").reshape(below, -1), at, axis=0, dtype=np.float64)
            yield _with_counts(part.drop_columns("counts").take(pa.array(at)), sums.reshape(-1, states))
        tiles = run.slice(below)
        for a, b in _edges(tiles.column("bucket").to_numpy()) if len(tiles) else []:
            part = tiles.slice(a, b - a)
            used, of = np.unique(_joined(part.column("ids"), "<i8"), return_inverse=True)
            counts = _counts_of(part, states)
            sums = np.stack([np.bincount(of, counts[:, k], len(used)) for k in range(states)], axis=1).astype(np.float32)
            yield _with_counts(part.drop_columns("counts"), sums[of])


def rare_places(coded: DataFrame, counts: DataFrame) -> DataFrame:
    """``coded(block, rare)``, ``counts(word, c)`` -> a row for each rare word of a block: ``block, slot, id, c, start``. A word's id modulo ``SHARED`` is the class of its last bytes; of words never
    seen the id is -1 - class and c is 0. start: the number of the disturbance it starts with."""
    listed = coded.filter("rare is not null").select("block", F.posexplode("rare").alias("slot", "word"))
    numbered = counts.withColumn("number", F.monotonically_increasing_id() * SHARED)
    kind = (F.crc32(F.substring("word", -2, 2)) % SHARED).cast("long")
    found = listed.join(numbered.hint("shuffle_hash"), "word", "left")
    return found.select("block", "slot", F.coalesce(F.col("number") + kind, -1 - kind).alias("id"), F.coalesce("c", F.lit(0)).alias("c"), (F.crc32("word") % STARTS).cast("int").alias("start"))


def rare_tiles(places: DataFrame, buckets: int, tasks: int) -> DataFrame:
    """``rare_places`` -> ``block, bucket, slots, ids, c, starts``: one row for each block and bucket of words, with the bytes of its places' numbers. All places of an id that is not negative are in
    one bucket; those of words never seen, which share ids, are spread."""
    key = F.when(F.col("id") < 0, F.hash("block", "slot")).otherwise(F.hash("id"))
    kinds = {"slots": ("slot", "<i4"), "ids": ("id", "<i8"), "c": ("c", "<i8"), "starts": ("start", "<i2")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "block"):
            block, bucket = table.column("block").to_numpy(), table.column("bucket").to_numpy()
            order = np.lexsort((table.column("slot").to_numpy(), bucket, block))
            block, bucket = block[order], bucket[order]
            at = [a for a, _ in _edges(block * buckets + bucket)]
            data = [pa.array([x.tobytes() for x in np.split(table.column(c).to_numpy()[order].astype(k), at[1:])], pa.binary()) for c, k in kinds.values()]
            yield pa.record_batch([pa.array(block[at]), pa.array(bucket[at]), *data], names=["block", "bucket", *kinds])

    dealt = places.withColumn("bucket", F.pmod(key, F.lit(buckets))).repartition("block").sortWithinPartitions("block").coalesce(tasks)
    return dealt.mapInArrow(run, "block long, bucket int, slots binary, ids binary, c binary, starts binary")


def _first_counts(tiles: DataFrame, shares: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield _with_counts(pa.Table.from_batches([b]).drop_columns("starts"), _joined(b.column("c"), "<i8")[:, None] * shares[_joined(b.column("starts"), "<i2")])

    return tiles.mapInArrow(run, TILES)


def _first_by_class(counts: DataFrame, shares: np.ndarray) -> np.ndarray:
    """First counts of all words by class and state."""
    names = [f"s{k}" for k in range(shares.shape[1])]
    start = counts.sparkSession.createDataFrame([(i, *map(float, x)) for i, x in enumerate(shares)], ", ".join(["place long", *(f"{c} double" for c in names)]))
    of = counts.select("c", (F.crc32("word") % STARTS).alias("place"), (F.crc32(F.substring("word", -2, 2)) % SHARED).alias("class")).join(F.broadcast(start), "place")
    sums = of.groupBy("class").agg(*(F.sum(F.col("c") * F.col(c)).alias(c) for c in names)).toPandas()
    out = np.zeros((SHARED, len(names)))
    out[sums["class"]] = sums[names].to_numpy()
    return out


def baum_welch(coded: DataFrame, tiles: DataFrame, by_class: np.ndarray, vocabulary: Vocabulary, distinct: int, tasks: int, shares: np.ndarray, rounds: int = ROUNDS) -> tuple[Hmm, DataFrame, Emissions]:
    """Train on ``coded(block, held_out, symbols)`` and its ``rare_tiles``, by_class being all words' first counts. -> the model with the known words' emissions, the tiles of all blocks, held out or not,
    with the rare words' counts by state, and what makes emissions of them. Each round is one pass; counts are added across partitions by word."""
    states, symbols = shares.shape[1], len(vocabulary.words)
    kinds = np.array([_shared_class(w) for w in vocabulary.words])
    known = vocabulary.counts[:, None] * shares[[zlib.crc32(w) % STARTS for w in vocabulary.words]]
    r = np.random.default_rng(1)
    starts, moves = np.full(states, 1 / states), r.dirichlet(np.full(states, 2.0), states) * 0.3 + np.eye(states) * 0.7
    trained = coded.filter("not held_out and symbols is not null").select("block", "n_tokens", "symbols")
    others, table = tiles.filter("block % 2 = 1").drop("starts"), _first_counts(tiles.filter("block % 2 = 0") if rounds else tiles, shares)
    before = None
    for n in range(rounds + 1):
        emissions = Emissions(by_class, distinct)
        model = Hmm(starts, moves, emissions.of(known))
        if n == rounds:
            return model, table, emissions

        def run(batches: Iterator[pa.RecordBatch], model: Hmm = Hmm(starts, moves, model.emit.astype(np.float32)), emissions: Emissions = emissions) -> Iterator[pa.RecordBatch]:
            total = np.zeros((symbols + states + 1 + SHARED, states))  # a row for each known word, then each state's moves, the starts, the rare words by class
            for _, sequences, here_tiles, slots, ids, _, counts in _blocks(batches, states):
                here = Hmm(model.start, model.move, np.concatenate([model.emit, emissions.of_places(ids, counts).astype(np.float32)]))
                begin, move, emit = here.expected(Packed(sequences), len(here.emit))
                total[:symbols] += emit[:symbols]
                total[symbols : symbols + states] += move
                total[symbols + states] += begin
                total[symbols + states + 1 :] += np.stack([np.bincount(ids % SHARED, emit[symbols:, k], SHARED) for k in range(states)], axis=1)
                if len(ids):
                    yield _with_counts(here_tiles.drop_columns("counts"), emit[symbols:][slots])
            total = np.concatenate([total, np.zeros((-len(total) % SHELF, states))]).reshape(-1, SHELF * states)
            some = np.flatnonzero(total.any(axis=1))
            if len(some):
                task, none = np.full(len(some), TaskContext.get().partitionId(), np.int64), pa.nulls(len(some), pa.binary())
                yield _with_counts(pa.table({"block": task, "bucket": (-1 - some).astype(np.int32), "slots": none, "ids": none, "c": none}), total[some].reshape(-1, states))

        found = materialize(_at_blocks(trained, table, tasks).mapInArrow(run, TILES), "block-counts", "zstd")
        if before is not None:
            discard(before)
        rows = found
        if n == rounds - 1:  # the texts held out need the sums as well
            rows = found.unionByName(others, allowMissingColumns=True)
        before = sums = materialize(rows.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(lambda batches: _added(batches, states), TILES), "expected-counts", "zstd")
        discard(found)
        table = sums.filter("bucket >= 0")
        few = sums.filter("bucket < 0").select("bucket", "counts").toArrow()  # no more than the known words
        rows = np.zeros((-(-(symbols + states + 1 + SHARED) // SHELF), SHELF * states))
        rows[-1 - few.column("bucket").to_numpy()] = _joined(few.column("counts"), "<f4").reshape(-1, states * SHELF)
        rows = rows.reshape(-1, states)[: symbols + states + 1 + SHARED]
        known, moves, starts, by_class = rows[:symbols], rows[symbols : symbols + states] + 1 / states, rows[symbols + states] + 1 / states, rows[symbols + states + 1 :]
        np.add.at(by_class, kinds, known)
        starts, moves = starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True)


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, known: int = KNOWN) -> DataFrame:
    """One row for each document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Null, empty and white-space texts are the end token alone. Repeated rows are counted, and scored, as often as they occur; null ids are never held out. Without training
    texts every count is 0. An empty table gives no rows; other columns are not used.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out_rows(F.col("doc_id")))
    counts = materialize(token_counts(d.filter("not held_out")), "token-counts", "zstd")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    is_end = F.col("word") == F.lit(END)
    ends = counts.filter(is_end).first()
    top = counts.filter(~is_end).orderBy(F.desc("c"), "word").limit(known).toArrow()  # at most ``known`` words
    top = list(zip(top.column("word").to_pylist(), top.column("c").to_pylist(), strict=True))
    top.append((END, ends.c if ends else 0))
    vocabulary = Vocabulary(top)
    # The known words' sums are a row for each task and word, so tasks have several blocks.
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, int(total) // (4 * TOGETHER))
    coded = materialize(code_texts(d.coalesce(4 * tasks), vocabulary), "coded", "zstd")
    shares = _first_shares(states)
    by_class = _first_by_class(counts, shares)
    tiles = materialize(rare_tiles(rare_places(coded, counts), 2 * tasks, tasks), "rare-tiles", "zstd")
    discard(counts)
    model, table, emissions = baum_welch(coded, tiles, by_class, vocabulary, distinct, tasks, shares, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, sequences, _, _, ids, c, by_state in _blocks(batches, states):
            here = Hmm(model.start, model.move, np.concatenate([model.emit, emissions.of_places(ids, by_state)]))
            also, more = np.zeros(len(sequences), np.int64), np.zeros(len(sequences))
            for i, x in enumerate(sequences):
                of = c[x[x >= len(vocabulary.words)] - len(vocabulary.words)]
                also[i], more[i] = (of > 0).sum(), np.log10(of + 1).sum()
            texts = texts.select(["doc_id", "held_out", "n_tokens", "n_known", "log_known"]).combine_chunks()
            columns = [pa.array(texts.column("n_known").to_numpy() + also), pa.array(texts.column("log_known").to_numpy() + more), pa.array(here.forward(Packed(sequences))[2])]
            yield pa.record_batch([*(texts.column(k).chunk(0) for k in range(3)), *columns], names=["doc_id", "held_out", "n_tokens", "n_known", "log_sum", "score"])

    scored = _at_blocks(coded.filter("symbols is not null").drop("rare"), table, tasks).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, log_sum double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("log_sum") - F.col("n_tokens") * F.lit(log10(total + distinct + 1))).alias("base_score"), "score")
