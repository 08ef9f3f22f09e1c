"""Language-model scores of documents by a hidden Markov model that Baum-Welch trains over all partitions.

Tokens are the words of a text, A-Z lower-cased, and one end.  The base is a unigram model: a token of ``c`` training tokens out of ``N`` has the probability ``(c + 0.1) / (N + 0.1 (V + 1))``,
and all unknown words together that of one word without any.

Model.  Latent states follow each other by a transition matrix; a state emits a class of words, and the class gives the word by its share of the class, as in the base.  Classes are the end,
unknown words, and hashes of words, so the model's size is fixed while every count is that of all training documents.  Emissions are drawn to the class's share in
the base by ``PRIOR`` counts; a model of one state is the base itself.  An unknown word is no class of its own in any training text, so each state gives it what the prior leaves.

Training.  Baum-Welch starts from a model of random states that was improved on a bounded sample of segments (``WARM`` of them, on the driver), and then makes ``PASSES`` passes over all training
documents: forward and backward recursions in each task, over segments of ``SEGMENT`` tokens, whose expected counts are summed for the whole task and then over all tasks.  A segment that
goes on inside a text starts from the mean state.  Expected counts are rounded to 2 ** -16 before they leave a slice, so their sums do not depend on order.

Scores are exact for whole texts of any length: a text is cut into chunks, the scaled forward recursion runs through a later chunk from every state at once, and the chunks' matrices are
multiplied in order.

Scale.  Texts are cut into slices of about ``SLICE`` bytes; a slice has each of its words once.  Only those words are shuffled: to one window a word, which sums the
training counts, and back to their slice.  A hot word is one row a slice.  Words are known by 64-bit hashes; two of a billion words share one with a probability of 3 %.  A very long text is a slice of its own.

Defined results: null text is empty, so its only token is the end; a document without id counts as held out; documents that repeat an id are scored each for itself; without training documents every token
is unknown, and the base gives it probability one; ids are of any type; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .textblock import flat, mixed, slices, span_hashes, word_spans

STATES, CLASSES = 8, 1 << 14
END, UNKNOWN = 0, 1
PRIOR = 3000.0
SLICE = 16 << 20
SEGMENT, CHUNK, FIRST_CHUNK = 256, 256, 1024
#: Tokens whose recursions run side by side; segments and rounds of the start; passes over all training documents.
TOKENS, WARM, WARM_ROUNDS, PASSES = 400_000, 2048, 10, 2
_UNIT = 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---- slices of tokens


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int = 1 << 20) -> np.ndarray:
    """Hashes of the words, a window of bytes at a time: hashing takes some dozen bytes of memory a byte of text."""
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + window, "right")))
        a, b = starts[first], ends[last - 1]
        out[first:last] = span_hashes(_LOWER[data[a:b]], starts[first:last] - a, ends[first:last] - a)
        first = last
    return out


def tokenized(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all rows, row by row (0 the end, else 1 + place in the dictionary); tokens of each row; hashes of the dictionary's words."""
    data, offsets = flat(column)
    starts, ends, rows = word_spans(data, offsets)
    keys, place = np.unique(_hashes(data, starts, ends), return_inverse=True)
    lengths = np.bincount(rows, minlength=len(column)) + 1
    tokens = np.zeros(int(lengths.sum()), np.int32)
    tokens[np.arange(len(rows)) + rows] = place + 1
    return tokens, lengths, keys.view(np.int64)


def word_class(keys: np.ndarray) -> np.ndarray:
    return np.mod(keys, CLASSES - 2) + 2


def sliced(docs: DataFrame) -> DataFrame:
    """One row a slice: ``slice, ids, train, lengths, tokens, classes, keys, counts``; ``counts`` are those of the slice's words in its training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                tokens, lengths, keys = tokenized(part.column("text"))
                train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
                counts = np.bincount(tokens[np.repeat(train, lengths)], minlength=len(keys) + 1)[1:]
                one = lambda values: pa.array([values.tobytes()], pa.binary())
                whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                columns = [pa.array([number]), whole(part.column("id")), one(train), one(lengths.astype(np.int32)), one(tokens), one(word_class(keys).astype(np.int16)), whole(pa.array(keys)), whole(pa.array(counts.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, ["slice", "ids", "train", "lengths", "tokens", "classes", "keys", "counts"])
                number += 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, F.lit(False))
    texts = docs.select(F.col("doc_id").alias("id"), train.alias("train"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"slice bigint, ids array<{kind}>, train binary, lengths binary, tokens binary, classes binary, keys array<bigint>, counts array<int>")


def counted(rows: DataFrame) -> DataFrame:
    """``slice, place, count, first, class``: the training count of each word of each slice; ``first`` once a word."""
    words = rows.select("slice", F.posexplode(F.arrays_zip("keys", "counts")).alias("place", "word")).select("slice", "place", F.col("word.keys").alias("key"), F.col("word.counts").alias("n"))
    every = Window.partitionBy("key")
    one = words.withColumns({"count": F.sum("n").over(every), "first": F.row_number().over(every.orderBy("slice")) == 1})
    return one.select("slice", "place", "count", "first", (F.pmod("key", F.lit(CLASSES - 2)) + 2).cast("int").alias("class"))


def _of(row: dict, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(row[name], kind)


def _class_tokens(row: dict) -> np.ndarray:
    return np.concatenate(([END], _of(row, "classes", np.int16))).astype(np.int32)[_of(row, "tokens", np.int32)]


# ---- the model


def started(shares: np.ndarray, states: int = STATES, seed: int = 11) -> dict[str, np.ndarray]:
    """Random states around the classes' shares."""
    chance = np.random.default_rng(seed)
    emission = shares * chance.lognormal(0.0, 1.0, (states, len(shares)))
    follow = chance.dirichlet(np.full(states, 2.0), states) + np.eye(states)
    return {"start": np.full(states, 1 / states), "mean": np.full(states, 1 / states), "follow": follow / follow.sum(1, keepdims=True), "emission": emission / emission.sum(1, keepdims=True)}


def renewed(counts: np.ndarray, shares: np.ndarray, prior: float = PRIOR) -> dict[str, np.ndarray]:
    """The model of expected counts: a row a class, then a row a state that others follow, then the starts."""
    states, size = counts.shape[1], len(shares)
    emission, follow, start = counts[:size].T, counts[size : size + states], counts[size + states]
    total = emission.sum(1, keepdims=True)
    emission = (emission + prior * shares) / (total + prior)
    mean = total[:, 0] + 1.0
    follow, start = follow + 1.0, start + 1.0
    return {"start": start / start.sum(), "mean": mean / mean.sum(), "follow": follow / follow.sum(1, keepdims=True), "emission": emission}


def _by_step(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequences, longest first, and how many have a token at each step."""
    order = np.argsort(-lengths, kind="stable")
    return order, np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")


def expected(model: dict[str, np.ndarray], classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, float]:
    """Expected counts, as ``renewed`` takes them, of sequences in an array of classes, and their log likelihood; ``opens``: starts a text."""
    states, size = len(model["start"]), model["emission"].shape[1]
    order, many = _by_step(lengths)
    starts, opens = starts[order], opens[order]
    own = classes[np.concatenate([starts[:n] + t for t, n in enumerate(many.tolist())])]
    emitted = np.ascontiguousarray(model["emission"].T)[own]
    edge = np.concatenate(([0], np.cumsum(many))).tolist()
    alpha, scale, follow = np.empty_like(emitted), np.empty(len(own)), model["follow"]
    for t in range(len(many)):
        a, b = edge[t], edge[t + 1]
        before = np.where(opens[:, None], model["start"], model["mean"]) if t == 0 else alpha[edge[t - 1] : edge[t - 1] + b - a] @ follow
        now = before * emitted[a:b]
        scale[a:b] = now.sum(1)
        alpha[a:b] = now / scale[a:b, None]
    gamma, crossed = alpha.copy(), np.zeros((states, states))
    after = np.ones((int(many[-1]), states))
    for t in range(len(many) - 1, 0, -1):
        a, b, c = edge[t], edge[t + 1], edge[t - 1]
        gamma[a:b] *= after
        coming = emitted[a:b] * after / scale[a:b, None]
        crossed += alpha[c : c + b - a].T @ coming
        after = np.ones((a - c, states))
        after[: b - a] = coming @ follow.T
    gamma[: edge[1]] *= after
    counts = np.zeros((size + states + 1, states))
    for s in range(states):
        counts[:size, s] = np.bincount(own, gamma[:, s], minlength=size)
    counts[size : size + states] = crossed * follow
    counts[size + states] = gamma[: edge[1]][opens].sum(0)
    return counts, float(np.log(scale).sum())


def segments(lengths: np.ndarray, chosen: np.ndarray, longest: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and openings of the segments of the chosen rows."""
    begins = np.cumsum(lengths) - lengths
    pieces = -(-lengths[chosen] // longest)
    number = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(begins[chosen], pieces) + number * longest
    return starts, np.minimum(longest, np.repeat((begins + lengths)[chosen], pieces) - starts), number == 0


def _in_turns(lengths: np.ndarray, tokens: int = TOKENS) -> Iterator[slice]:
    """Runs of sequences with about so many tokens each."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + tokens, "right")))
        yield slice(at, last)
        at = last


def baum_welch(rows: DataFrame, model: dict[str, np.ndarray], shares: np.ndarray) -> dict[str, np.ndarray]:
    """One pass over all training documents of ``sliced`` rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    states, size = len(model["start"]), len(shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + states + 1, states), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                classes, lengths = _class_tokens(row), _of(row, "lengths", np.int32).astype(np.int64)
                starts, sizes, opens = segments(lengths, np.flatnonzero(_of(row, "train", bool)))
                for part in _in_turns(sizes):
                    total += np.rint(expected(shared.value, classes, starts[part], sizes[part], opens[part])[0] * _UNIT).astype(np.int64)
        place = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(place), *(pa.array(total[place, s]) for s in range(states))], ["place", *(f"s{s}" for s in range(states))])

    names = [f"s{s}" for s in range(states)]
    summed = rows.select("train", "lengths", "tokens", "classes").mapInArrow(run, "place bigint, " + ", ".join(f"{c} bigint" for c in names)).groupBy("place").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    counts = np.zeros((size + states + 1, states))
    counts[summed.column("place").to_numpy()] = np.stack([summed.column(c).to_numpy() for c in names], 1) / _UNIT
    return renewed(counts, shares)


def warmed(rows: DataFrame, shares: np.ndarray, total: int) -> dict[str, np.ndarray]:
    """The start of training: a few rounds over a sample of about ``WARM`` of the ``total`` training segments, by hash."""
    least = int(min(1.0, WARM / max(1, total)) * 2**32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                classes, lengths = _class_tokens(row), _of(row, "lengths", np.int32).astype(np.int64)
                starts, sizes, opens = segments(lengths, np.flatnonzero(_of(row, "train", bool)))
                chance = mixed(mixed(np.arange(len(starts), dtype=np.uint64) + np.uint64(1)) ^ np.uint64(row["slice"])) >> np.uint64(32)
                taken = np.flatnonzero(chance <= np.uint64(least))
                sample = [classes[starts[i] : starts[i] + sizes[i]].tobytes() for i in taken]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(taken), row["slice"])), pa.array(taken), pa.array(opens[taken]), pa.array(sample, pa.binary())], ["slice", "number", "opens", "classes"])

    found = rows.select("slice", "train", "lengths", "tokens", "classes").mapInArrow(run, "slice bigint, number bigint, opens boolean, classes binary").orderBy("slice", "number").limit(2 * WARM).toArrow()
    model = started(shares)
    if not len(found):
        return model
    texts = [np.frombuffer(x, np.int32) for x in found.column("classes").to_pylist()]
    sizes, opens = np.array([len(x) for x in texts]), found.column("opens").to_numpy()
    for _ in range(WARM_ROUNDS):
        model = renewed(expected(model, np.concatenate(texts), np.cumsum(sizes) - sizes, sizes, opens)[0], shares, PRIOR / 10)
    return model


# ---- scores


def _through(model: dict[str, np.ndarray], vectors: np.ndarray, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, opens: bool) -> tuple[np.ndarray, np.ndarray]:
    """Forward vectors (sequence, start, state) at each sequence's end, each with sum one, and the logs of what they were scaled by."""
    order, many = _by_step(lengths)
    emission, follow = np.ascontiguousarray(model["emission"].T), model["follow"]
    states = len(follow)
    now, logs, begin = vectors[order], np.zeros(vectors.shape[:2]), starts[order]
    for t, n in enumerate(many.tolist()):
        emitted = emission[classes[begin[:n] + t]][:, None, :]
        moved = now[:n] if opens and t == 0 else (now[:n].reshape(-1, states) @ follow).reshape(n, -1, states)
        now[:n] = moved * emitted
        if t % 8 == 7 or t + 1 == len(many) or many[t + 1] < n:
            size = now[:n].sum(2)
            now[:n] /= size[:, :, None]
            logs[:n] += np.log(size)
    back = np.argsort(order)
    return now[back], logs[back]


def likelihoods(model: dict[str, np.ndarray], classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The natural log of the probability of each sequence of classes: exact, whatever its length."""
    states, begins, out = len(model["start"]), np.cumsum(lengths) - lengths, np.zeros(len(lengths))
    for part in _in_turns(lengths):
        own, sizes = begins[part], lengths[part]
        vector, log = _through(model, np.repeat(model["start"][None, None], len(own), 0), classes, own, np.minimum(sizes, FIRST_CHUNK), True)
        vector, log = vector[:, 0], log[:, 0]
        pieces = np.maximum(0, -(-(sizes - FIRST_CHUNK) // CHUNK))
        row = np.repeat(np.arange(len(own)), pieces)
        number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = own[row] + FIRST_CHUNK + number * CHUNK
        many = np.minimum(CHUNK, (own + sizes)[row] - starts)
        place = np.cumsum(pieces) - pieces
        matrices, logs = np.zeros((len(row), states, states)), np.zeros((len(row), states))
        for turn in _in_turns(many, TOKENS // states):
            matrices[turn], logs[turn] = _through(model, np.repeat(np.eye(states)[None], len(starts[turn]), 0), classes, starts[turn], many[turn], False)
        for step in range(int(pieces.max(initial=0))):
            open_ = np.flatnonzero(pieces > step)
            at = place[open_] + step
            top = logs[at].max(1)
            moved = ((vector[open_] * np.exp(logs[at] - top[:, None]))[:, None] @ matrices[at])[:, 0]
            size = moved.sum(1)
            vector[open_], log[open_] = moved / size[:, None], log[open_] + top + np.log(size)
        out[part] = log
    return out


def _scores(slice_: pa.Table, words: pa.Table, model: dict[str, np.ndarray], shares: np.ndarray, total: int, distinct: int, ends: int) -> pa.Table:
    out = []
    for row, ids in zip(slice_.drop_columns(["ids"]).to_pylist(), slice_.column("ids").combine_chunks()):
        tokens, lengths = _of(row, "tokens", np.int32), _of(row, "lengths", np.int32).astype(np.int64)
        counts = np.zeros(len(row["classes"]) // 2 + 1, np.int64)
        counts[0] = ends
        counts[words.column("place").to_numpy() + 1] = words.column("count").to_numpy()
        classes = np.concatenate(([END], _of(row, "classes", np.int16))).astype(np.int32)
        classes[counts == 0] = UNKNOWN
        base = np.log10((counts + 0.1) / (total + 0.1 * (distinct + 1)))
        given = base - np.log10(shares[classes])  # the word within its class
        begins = np.cumsum(lengths) - lengths
        summed = lambda values: np.add.reduceat(values[tokens], begins)
        score = summed(given) + likelihoods(model, classes[tokens], lengths) / np.log(10)
        n, known = len(lengths), np.add.reduceat((counts > 0)[tokens].astype(np.int64), begins)
        columns = [ids.values, pa.array(~_of(row, "train", bool)), pa.array(lengths), pa.array(known), pa.array(np.full(n, total)), pa.array(summed(base)), pa.array(score)]
        out.append(pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
    return pa.concat_tables(out) if out else None


def trained(rows: DataFrame, words: DataFrame, passes: int = PASSES) -> tuple[dict[str, np.ndarray], np.ndarray, int, int, int]:
    """The model, the classes' shares of the base, all training tokens, the distinct ones, and the training documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [_of(row, "lengths", np.int32)[_of(row, "train", bool)] for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in sizes], pa.int64()), pa.array([int((-(-x // SEGMENT)).sum()) for x in sizes], pa.int64())], ["texts", "segments"])

    ends, pieces = rows.select("train", "lengths").mapInArrow(run, "texts bigint, segments bigint").agg(F.coalesce(F.sum("texts"), F.lit(0)), F.coalesce(F.sum("segments"), F.lit(0))).first()
    by_class = words.filter("first and count > 0").groupBy("class").agg(F.count("*").alias("words"), F.sum("count").alias("tokens")).toArrow()
    kinds, tokens = (np.zeros(CLASSES, np.int64) for _ in range(2))
    place = by_class.column("class").to_numpy()
    kinds[place], tokens[place] = by_class.column("words").to_numpy(), by_class.column("tokens").to_numpy()
    kinds[END], tokens[END] = int(ends > 0), ends
    total, distinct = int(tokens.sum()), int(kinds.sum())
    shares = tokens + 0.1 * kinds
    shares[UNKNOWN] = 0.1
    shares = shares / (total + 0.1 * (distinct + 1))
    model = warmed(rows, shares, pieces)
    for _ in range(passes if ends else 0):
        model = baum_welch(rows, model, shares)
    return model, shares, total, distinct, ends


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``doc_id, text``."""
    rows = written(sliced(docs), "slices")
    words = written(counted(rows), "words")
    model, shares, total, distinct, ends = trained(rows, words)
    shared = docs.sparkSession.sparkContext.broadcast((model, shares))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    own = rows.select("slice", "ids", "train", "lengths", "tokens", "classes").groupBy("slice")
    return own.cogroup(words.select("slice", "place", "count").groupBy("slice")).applyInArrow(lambda left, right: _scores(left, right, *shared.value, total, distinct, ends), schema)
