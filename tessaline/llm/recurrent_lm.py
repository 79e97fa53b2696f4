"""Gated recurrent language model with a class-factored softmax, in numpy.

Text: A-Z in lower case, words are runs of bytes other than ASCII white space, then one end.
Counts of all training tokens come from all documents. The model's vocabulary has three parts:
the MAX_WORDS most frequent tokens, in classes of about equal total count; rarer words, in
classes by the power of two of their count; and unknown words, which count as one
token and share a class with words seen once. A token's probability is P(class | state) *
P(token | class, state); within the classes of rare words the second factor is the
token's share of its class's count, and within the class of words seen once the unknown
token has the Good-Turing share N1 / (N1 + 2 N2). The probabilities thus sum to 1 over the
known tokens and the unknown one. Classes of rare words and the counts grow with the corpus.

A gated recurrent unit carries the state. Training runs truncated backpropagation over
windows of STEPS tokens in up to STREAMS parallel streams, each a row of whole documents; the
state goes from window to window and is reset at document starts only. Where a long
document outlasts the other streams, windows get longer, so that its rest costs little. Three
rounds take disjoint shares of the training documents, chosen by hash, and together every
document once; in a round each task starts from the last round's weights and trains on all
it reads, at most CHUNK_TOKENS at a time, and the tasks' weights are averaged by their tokens.
Scoring carries the state through whole documents of any length.

Texts are read and split once. A task numbers the words of about BLOCK_BYTES of text, a
block, and writes the documents as numbers beside the block's words with their counts. The
words' counts over the corpus reach the blocks by joins, so that nothing that grows with
the corpus is broadcast or collected; the driver gets the MAX_WORDS top counts, a few sums
and the averaged weights. Training and scoring read the documents as inputs of the model, two
bytes a token, from a table in the shared folder, without a shuffle.

Defined results: null and empty texts are a single end; very long texts are scored whole,
in one task; rows with a null doc_id are training rows (their fold is not the held-out one)
and are scored; repeated rows count as often as they occur; words of equal count are ranked by
their bytes; without training tokens every token is unknown; other columns are ignored,
whatever their names; an empty table gives an empty table. The weights depend in small
ways on how the input is split into tasks; counts and base scores do not.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import remove_folder, scratch_folder, write_table

FOLDS, HELD_OUT = 7, 2
MAX_WORDS, TOP_CLASSES = 2048, 32
EMBED, STATE, STEPS, STREAMS = 16, 24, 16, 512
LANES = 1024  # documents scored side by side
LONGEST_WINDOW = 256
LARGEST_LOGIT = 80.0  # sums of exp of what is below stay within float32
BLOCK_BYTES, PIECE_BYTES = 32 << 20, 1 << 19
CHUNK_TOKENS, SCORE_TOKENS, FLUSH_TOKENS = 8 << 20, 4 << 20, 1 << 14
SHARES = 16
ROUNDS = ((1, 1e-2), (4, 5e-3), (16, 2e-3))  # the first share that is not in the round, and its learning rate
END = b""


def tokens(texts: pa.Array) -> pa.ListArray:
    """The tokens of each text (null: empty)."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    empty = pc.equal(pc.binary_length(texts), 0)
    return pc.ascii_split_whitespace(pc.if_else(empty, "", pc.binary_join_element_wise(texts, "", " ")))  # nothing after the last space: the end


@dataclass
class Vocabulary:
    """What the driver knows of the counts: the top words with counts, and number and total of the rarer words by band."""

    top: list[bytes]
    counts: np.ndarray
    bands: dict[int, tuple[int, int]]  # band: (words, tokens)
    twice: int  # words seen twice
    total: int
    distinct: int
    end: int = field(init=False)

    def __post_init__(self):
        share = np.cumsum(self.counts) - self.counts / 2
        top_total = max(int(self.counts.sum()), 1)
        own = np.minimum((share * TOP_CLASSES / top_total).astype(np.int64), TOP_CLASSES - 1)
        used = np.unique(own)
        self.class_of_top = np.searchsorted(used, own)
        self.n_top_classes = len(used)
        self.starts = np.searchsorted(self.class_of_top, np.arange(self.n_top_classes + 1))
        self.band_list = np.array(sorted({0, *self.bands}), dtype=np.int64)
        self.n_classes = self.n_top_classes + len(self.band_list)
        once = self.bands.get(0, (0, 0))[1]
        self.unknown_share = once / (once + 2 * self.twice) if once else 1.0
        self.n_inputs = len(self.top) + len(self.band_list)
        self.class_of = np.concatenate([self.class_of_top, np.arange(self.n_top_classes, self.n_classes)]).astype(np.int16)  # by input number
        self.end = self.top.index(END) if END in self.top else 0

    def place(self, top: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words with their number among the top words (-1 for others) and corpus counts: input number, and natural log of the share within a class of rare words (0 in top classes)."""
        inputs, inner = top.astype(np.int64), np.zeros(len(top))
        rest = np.flatnonzero(top < 0)
        band = np.where(counts[rest] > 0, np.log2(np.maximum(counts[rest], 1) + 0.5).astype(np.int64), 0)
        inputs[rest] = len(self.top) + np.searchsorted(self.band_list, band)
        totals = np.array([max(self.bands.get(int(b), (0, 0))[1], 1) for b in self.band_list], dtype=np.float64)
        share = np.maximum(counts[rest], 1) / totals[inputs[rest] - len(self.top)]
        share = np.where(counts[rest] == 0, self.unknown_share, np.where(band == 0, share * (1 - self.unknown_share), share))
        inner[rest] = np.log(share)
        return inputs.astype(np.uint16), inner

    def shapes(self) -> dict[str, tuple[int, ...]]:
        """The weights. The last row of wc and the last column of wo are biases."""
        return {"embed": (self.n_inputs, EMBED), "wx": (EMBED, 3 * STATE), "wh": (STATE, 3 * STATE), "b": (3 * STATE,), "wc": (STATE + 1, self.n_classes), "wo": (len(self.top), STATE + 1)}

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes().items():
            size = int(np.prod(shape))
            out[name] = flat[at : at + size].reshape(shape)
            at += size
        return out

    def start(self) -> np.ndarray:
        """First weights in one array: random, with the counts as output biases."""
        rng = np.random.default_rng(11)
        flat = np.zeros(sum(int(np.prod(s)) for s in self.shapes().values()), np.float32)
        w = self.views(flat)
        w["embed"][:] = rng.standard_normal(w["embed"].shape) * 0.3
        for name in ("wx", "wh"):
            w[name][:] = rng.standard_normal(w[name].shape) / np.sqrt(len(w[name]))
        mass = np.concatenate([np.add.reduceat(self.counts, self.starts[:-1]) if len(self.top) else np.zeros(0), [self.bands.get(int(b), (0, 0))[1] for b in self.band_list]]).astype(np.float64)
        mass[self.n_top_classes] += 2 * self.twice + 1
        w["wc"][-1] = np.log(mass / mass.sum() + 1e-9)
        for s, e in zip(self.starts[:-1], self.starts[1:]):  # shares within the class
            w["wo"][s:e, -1] = np.log(np.maximum(self.counts[s:e], 1) / max(int(self.counts[s:e].sum()), 1))
        return flat


def _by_gate(rows: np.ndarray) -> np.ndarray:
    """A view (3, rows, STATE) of rows of three gates."""
    return rows.reshape(len(rows), 3, STATE).swapaxes(0, 1)


def _softmax(x: np.ndarray, target: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """exp(x) in place of x, its sums by row; and the log probability of each row's target, if given."""
    if x.size and (x.max() > LARGEST_LOGIT or x.min() < -LARGEST_LOGIT):  # logits that may leave the range of exp
        x -= x.max(axis=1, keepdims=True)
    picked = None if target is None else x.reshape(-1).take(np.arange(0, x.size, x.shape[1]) + target)
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    return total, None if target is None else picked - np.log(total)


class GatedModel:
    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray):
        self.v, self.flat = vocabulary, flat.copy()
        self.w = vocabulary.views(self.flat)
        self.rooms: dict[str, np.ndarray] = {}

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array to fill, in memory that the next call for this name takes again."""
        size = math.prod(shape)
        if name not in self.rooms or self.rooms[name].size < size:
            self.rooms[name] = np.empty(size, self.flat.dtype)
        return self.rooms[name][:size].reshape(shape)

    def projected(self) -> np.ndarray:
        """What each input adds to the update gate, the reset gate and the candidate: (3, inputs, STATE), so that each is one run of memory."""
        return _by_gate(self.w["embed"] @ self.w["wx"] + self.w["b"]).copy()

    def step(self, gates: np.ndarray, h: np.ndarray, out: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """The next state, from rows of gates or from (3, rows, STATE); out receives the update and reset gates with the candidate's recurrent part, and the candidate, for the way back."""
        if gates.ndim == 2:
            gates = _by_gate(gates)
        own = _by_gate(h @ self.w["wh"])
        zr, inner = np.add(own[:2], gates[:2], out=out[0][:2] if out else np.empty((2, *h.shape), h.dtype)), own[2]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        if out:
            out[0][2] = inner
        n = np.multiply(zr[1], inner, out=out[1] if out else np.empty_like(h))
        n += gates[2]
        np.tanh(n, out=n)
        new = h - n
        new *= zr[0]
        new += n
        return new

    def outputs(self, h: np.ndarray, target: np.ndarray, grads: dict | None = None, scale: float = 1.0) -> np.ndarray:
        """Natural log probability of each target input number (shares within rare classes left out); with grads, fills those of the outputs and returns the gradient for the state instead. h has a last column of ones."""
        w, classes = self.w, self.v.class_of.take(target)
        order = np.argsort(classes, kind="stable")
        h, target, classes = h.take(order, 0, self.room("sorted", *h.shape), "clip"), target.take(order).astype(np.int64), classes.take(order).astype(np.int64)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        scale = h.dtype.type(scale)

        def slopes(x: np.ndarray, total: np.ndarray, at: np.ndarray):
            x *= (scale / total)[:, None]
            x.reshape(-1)[np.arange(0, x.size, x.shape[1]) + at] -= scale

        x = np.matmul(h, w["wc"], out=self.room("classes", len(h), self.v.n_classes))
        total, found = _softmax(x, classes if grads is None else None)
        if grads is None:
            found = found.astype(np.float64)
        else:
            slopes(x, total, classes)
            np.matmul(h.T, x, out=grads["wc"])
            dh = np.matmul(x, w["wc"][:STATE].T, out=self.room("slopes", len(h), STATE))
            grads["wo"][:] = 0
        at = np.searchsorted(classes, np.arange(self.v.n_top_classes + 1)).tolist()
        starts = self.v.starts.tolist()
        for k in range(self.v.n_top_classes):
            s, e = starts[k], starts[k + 1]
            if e - s < 2 or at[k] == at[k + 1]:
                continue
            own = slice(at[k], at[k + 1])
            mine, hk, wo = target[own] - s, h[own], w["wo"][s:e]
            x = hk @ wo.T
            total, logq = _softmax(x, mine if grads is None else None)
            if grads is None:
                found[own] += logq
            else:
                slopes(x, total, mine)
                np.matmul(x.T, hk, out=grads["wo"][s:e])
                dh[own] += x @ wo[:, :STATE]
        return found.take(back) if grads is None else dh.take(back, 0)

    def window(self, inputs, keep, target, valid, h, grads):
        """One window of truncated backpropagation: fills grads and returns the last state. Arrays are (steps, streams)."""
        w, (steps, streams) = self.w, inputs.shape
        kind = h.dtype
        at = inputs.ravel().astype(np.intp)
        gates = self.projected().take(at, 1, self.room("gates", 3, len(at), STATE), "clip").reshape(3, steps, streams, STATE)
        g = self.room("g", *gates.shape)
        before, n = (self.room(name, steps, streams, STATE) for name in ("before", "n"))
        states = self.room("states", steps, streams, STATE + 1)
        states[:, :, STATE] = 1
        resets = [np.flatnonzero(k == 0) for k in keep]
        for t in range(steps):
            before[t] = h
            before[t, resets[t]] = 0
            h = self.step(gates[:, t], before[t], (g[:, t], n[t]))
            states[t, :, :STATE] = h
        states, ok = states.reshape(-1, STATE + 1), valid.ravel()
        if ok.all():
            dstate = self.outputs(states, target.ravel(), grads, 1.0 / len(ok))
        else:
            ok = np.flatnonzero(ok)
            dstate = np.zeros((steps * streams, STATE), kind)
            dstate[ok] = self.outputs(states.take(ok, 0), target.ravel().take(ok), grads, 1.0 / max(len(ok), 1))
        dstate = dstate.reshape(steps, streams, STATE)
        outer = gates[2]  # slope of the candidate before its recurrent part is scaled
        to_before = _by_gate(w["wh"]).swapaxes(1, 2)
        after = np.zeros((streams, STATE), kind)
        for t in range(steps - 1, -1, -1):  # a step's arrays are small enough for the cache
            dh, (z, r, inner) = dstate[t], g[:, t]
            dh += after
            rest = 1 - z
            rest *= dh
            dh *= z
            slope = n[t] * n[t]
            np.subtract(1, slope, out=slope)
            np.multiply(rest, slope, out=outer[t])
            np.subtract(1, r, out=slope)
            slope *= inner
            np.multiply(outer[t], r, out=inner)  # from here on g holds slopes
            np.multiply(slope, inner, out=r)
            np.subtract(before[t], n[t], out=slope)
            slope *= rest
            z *= slope
            after, reset, candidate = np.matmul(g[:, t], to_before)
            after += reset
            after += candidate
            after += dh
            after[resets[t]] = 0
        g = g.reshape(3, len(at), STATE)
        np.matmul(before.reshape(-1, STATE).T, g, out=_by_gate(grads["wh"]))
        g[2] = outer.reshape(-1, STATE)
        np.matmul(w["embed"].take(at, 0).T, g, out=_by_gate(grads["wx"]))
        np.matmul(np.ones(len(at), kind), g, out=grads["b"].reshape(3, STATE))
        dx, *rest = np.matmul(g, _by_gate(w["wx"]).swapaxes(1, 2), out=self.room("dx", 3, len(at), EMBED))
        for part in rest:
            dx += part
        for d in range(EMBED):
            grads["embed"][:, d] = np.bincount(at, dx[:, d], len(w["embed"]))
        return h

    def train(self, docs: list[np.ndarray], rate: float, moments: dict) -> int:
        """One pass over documents of input numbers; returns the tokens seen. moments carries the optimiser from chunk to chunk."""
        sizes = [len(d) for d in docs]
        total = sum(sizes)
        streams = max(8, min(STREAMS, total // 1024))
        order = np.random.default_rng(total).permutation(len(docs)).tolist()
        order.sort(key=lambda i: sizes[i] * streams < total)  # documents longer than a mean stream begin
        load, lanes = [(0, k) for k in range(streams)], [[] for _ in range(streams)]
        for i in order:  # to the shortest stream so far
            size, k = heapq.heappop(load)
            lanes[k].append(i)
            heapq.heappush(load, (size + sizes[i], k))
        lengths = np.zeros(streams, np.int64)
        for size, k in load:
            lengths[k] = size
        longest = np.argsort(-lengths, kind="stable")
        lengths = lengths[longest]
        order = [i for k in longest for i in lanes[k]]
        target = np.concatenate([docs[i] for i in order])
        begin = np.cumsum([sizes[i] for i in order]) - [sizes[i] for i in order]
        inputs = np.empty_like(target)
        inputs[1:], first = target[:-1], np.zeros(len(target), bool)
        first[begin] = True
        inputs[first] = self.v.end
        lane_begin = np.cumsum(lengths) - lengths
        h = np.zeros((streams, STATE), np.float32)
        gradient = np.zeros_like(self.flat)
        grads, change = self.v.views(gradient), np.empty_like(gradient)
        one, two = (moments.setdefault(k, np.zeros_like(self.flat)) for k in ("one", "two"))
        s = 0
        while s < lengths[0]:
            live = int(np.searchsorted(-lengths, -s))  # streams longer than s
            steps = int(min(max(STEPS, STEPS * streams // (8 * live)), LONGEST_WINDOW, lengths[0] - s))
            ahead = s + np.arange(steps)[:, None]
            valid = ahead < lengths[:live]
            at = np.minimum(lane_begin[:live] + ahead, len(target) - 1)
            keep = (~first.take(at)).astype(np.float32)
            h = self.window(inputs.take(at), keep, target.take(at), valid, h[:live], grads)
            s += steps
            gradient *= np.float32(min(1.0, 1.0 / (np.sqrt(float(gradient @ gradient)) + 1e-9)))
            moments["steps"] = number = moments.get("steps", 0) + 1
            np.subtract(gradient, one, out=change)
            change *= np.float32(0.1)
            one += change
            gradient *= gradient
            np.subtract(gradient, two, out=change)
            change *= np.float32(0.01)
            two += change
            np.sqrt(two, out=gradient)
            gradient += np.float32(1e-6)
            np.divide(one, gradient, out=gradient)
            gradient *= np.float32(rate * np.sqrt(1 - 0.99**number) / (1 - 0.9**number))
            self.flat -= gradient
        return total

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each whole document, without the shares within rare classes."""
        order = np.argsort([-len(d) for d in docs], kind="stable")
        projected, out = self.projected(), np.empty(len(docs))
        for begin in range(0, len(order), LANES):  # documents of like lengths; a step's arrays are small enough for the cache
            part = order[begin : begin + LANES]
            out[part] = self._score_lanes([docs[i] for i in part], projected)
        return out

    def _score_lanes(self, docs: list[np.ndarray], projected: np.ndarray) -> np.ndarray:
        """Scores of documents side by side, the longest first."""
        n, ids = len(docs), np.concatenate(docs)
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        begin = np.cumsum(sizes) - sizes
        found = np.zeros(n)
        h = np.zeros((n, STATE), np.float32)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def flush():
            at = np.concatenate([a for a, _ in held])
            states = np.ones((len(at), STATE + 1), np.float32)
            np.concatenate([s for _, s in held], out=states[:, :STATE])
            logs, done = self.outputs(states, ids.take(at)), 0
            for a, _ in held:  # the documents still running come first
                found[: len(a)] += logs[done : done + len(a)]
                done += len(a)

        live = n
        for t in range(int(sizes[0])):
            if sizes[live - 1] <= t:
                live = int(np.searchsorted(-sizes, -t))
            at = begin[:live] + t
            previous = ids.take(at - 1) if t else np.full(live, self.v.end)
            h = self.step(projected.take(previous, 1), h[:live])
            held.append((at, h))
            waiting += live
            if waiting >= FLUSH_TOKENS:
                flush()
                held, waiting = [], 0
        if held:
            flush()
        return found


# Spark


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


BLOCKS = "block long, doc_id long, held boolean, share int, ids binary, number int, word binary, n long"


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of the values from each bound to the next."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(values.itemsize * bounds), pa.py_buffer(values)]).cast(pa.binary())


def _read_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Documents as numbers of their block's words, and after them the block's words with their occurrences in training rows (0 for words of held-out rows only)."""
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("share", pa.int32()), ("ids", pa.binary()), ("number", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])
    block = TaskContext.get().partitionId() << 24

    def rows(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def done() -> Iterator[pa.RecordBatch]:
        coded = pa.chunked_array([own.flatten() for _, own in pieces]).dictionary_encode()  # numbers words as they come
        names = coded.chunk(coded.num_chunks - 1).dictionary.cast(pa.binary())
        n = np.zeros(len(names), np.int64)
        for (docs, own), numbers in zip(pieces, coded.chunks):
            bounds, at = own.offsets.to_numpy().astype(np.int64), numbers.indices.to_numpy()
            training = np.repeat(~docs["held"].to_numpy(zero_copy_only=False), np.diff(bounds))
            n += np.bincount(at[training], minlength=len(n))
            yield rows(len(own), block=np.full(len(own), block), ids=_binary(at, bounds), **docs)
        for s in range(0, len(names), 50_000):
            part = names[s : s + 50_000]
            yield rows(len(part), block=np.full(len(part), block), number=np.arange(s, s + len(part), dtype=np.int32), word=part, n=n[s : s + 50_000])

    pieces: list[tuple[dict[str, pa.Array], pa.ListArray]] = []
    size = 0
    for batch in batches:
        doc_ids, helds, shares, texts = batch.columns
        piece = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // min(PIECE_BYTES, block_bytes)
        ends = [*(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for begin, end in zip([0, *ends], ends):
            part = slice(begin, end)
            own = tokens(texts[part])
            pieces.append(({"doc_id": doc_ids[part], "held": helds[part], "share": shares[part]}, own))
            size += 5 * len(own.values)
            if size >= block_bytes:
                yield from done()
                pieces, size, block = [], 0, block + 1
    if pieces:
        yield from done()


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The driver's view of (word, c)."""
    counts = counts.filter("c > 0")
    bounded = counts.orderBy(F.desc("c"), "word").limit(MAX_WORDS).collect()  # MAX_WORDS rows at most
    names, numbers = [bytes(r.word) for r in bounded], np.array([r.c for r in bounded], dtype=np.int64)
    if END not in names and names:  # fewer than MAX_WORDS documents among very frequent words: END replaces the rarest
        end = counts.filter(F.length("word") == 0).first()
        if end:
            names[-1], numbers[-1] = END, end.c
    own = counts.sparkSession.createDataFrame([(w,) for w in names], "word binary")
    band = F.floor(F.log2(F.col("c") + 0.5)).cast("int")
    rows = counts.join(F.broadcast(own.withColumn("top", F.lit(True))), "word", "left").groupBy(F.when(F.col("top").isNull(), band).alias("band"), (F.col("c") == 2).alias("two")).agg(F.count("*").alias("w"), F.sum("c").alias("n")).collect()  # two rows a power of two at most
    bands: dict[int, tuple[int, int]] = {}
    for r in rows:
        if r.band is not None:
            have = bands.get(r.band, (0, 0))
            bands[r.band] = (have[0] + r.w, have[1] + r.n)
    return Vocabulary(names, numbers, bands, sum(r.w for r in rows if r.two), sum(r.n for r in rows), sum(r.w for r in rows))


ENCODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inner double, inputs binary, round int"


def _encode(docs: pa.Table, words: pa.Table, v: Vocabulary) -> pa.Table:
    """A block's documents as inputs of the model, with the sums that need the counts of rare words."""
    number = words.column("number").to_numpy()
    counts, top = np.zeros(len(number), np.int64), np.full(len(number), -1)
    counts[number] = words.column("c").to_numpy()
    top[number] = words.column("top").to_numpy()
    inputs, inner = v.place(top, counts)
    base = np.log10((counts + 1.0) / (v.total + v.distinct + 1))
    seen = (counts > 0).astype(np.int64)
    found: list[tuple] = []
    for ids in (chunk.slice(i, 1000) for chunk in docs.column("ids").chunks for i in range(0, len(chunk), 1000)):
        sizes, at = pc.binary_length(ids).to_numpy().astype(np.int64) // 4, np.frombuffer(b"".join(ids.to_pylist()), np.int32)
        begin = np.cumsum(sizes) - sizes  # no document is without tokens
        found.append((sizes, *(np.add.reduceat(x[at], begin) for x in (seen, base, inner)), _binary(inputs[at], np.append(begin, len(at)))))
    sizes, known, bases, inners, arrays = (pa.chunked_array(x) for x in zip(*(map(pa.array, part) for part in found))) if found else (pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()))
    held = docs.column("held")
    share = docs.column("share").to_numpy()
    rounds = np.searchsorted([last for last, _ in ROUNDS], share, side="right").astype(np.int32)
    rounds[held.to_numpy()] = len(ROUNDS)  # never trained on
    return pa.table({"doc_id": docs.column("doc_id"), "held_out": held, "n_tokens": sizes, "n_known": known, "base_score": bases, "inner": inners, "inputs": arrays, "round": pa.array(rounds)})


def encode(docs: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, Vocabulary]:
    """The documents as inputs of the model, in a table under folder, and the vocabulary."""
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARES)).cast("int")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.select("doc_id", held_out(F.col("doc_id")).alias("held"), share.alias("share"), "text")
    read = write_table(own.mapInArrow(lambda batches: _read_blocks(batches, block_bytes), BLOCKS), f"{folder}/blocks")
    words = read.filter(F.col("word").isNotNull()).select("block", "number", "word", "n")
    counts = write_table(words.groupBy("word").agg(F.sum("n").alias("c")), f"{folder}/counts")
    v = vocabulary(counts)
    top = docs.sparkSession.createDataFrame(list(enumerate(v.top)), "top int, word binary")
    known = words.drop("n").join(counts, "word").join(F.broadcast(top), "word", "left").select(F.col("block").alias("owner"), "number", "c", F.coalesce("top", F.lit(-1)).alias("top"))
    texts = read.filter(F.col("word").isNull()).select("block", "doc_id", "held", "share", "ids")
    encoded = texts.groupBy("block").cogroup(known.groupBy("owner")).applyInArrow(lambda left, right: _encode(left, right, v), ENCODED)
    encoded = write_table(encoded, f"{folder}/encoded", "round")
    remove_folder(docs.sparkSession, f"{folder}/blocks")
    remove_folder(docs.sparkSession, f"{folder}/counts")
    return encoded, v


PART, FAN = 2048, 64


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Rows, and their documents, of about so many tokens at a time."""
    rows: list[pa.RecordBatch] = []
    docs: list[np.ndarray] = []
    size = 0
    for batch in batches:
        inputs = batch.column(batch.schema.get_field_index("inputs"))
        begin = 0
        for i in range(batch.num_rows):
            docs.append(np.frombuffer(inputs[i].as_py(), np.uint16))
            size += len(docs[-1])
            if size >= most:
                rows.append(batch.slice(begin, i + 1 - begin))
                yield rows, docs
                rows, docs, size, begin = [], [], 0, i + 1
        if begin < batch.num_rows:
            rows.append(batch.slice(begin))
    if docs:
        yield rows, docs


def _fit(batches: Iterator[pa.RecordBatch], v: Vocabulary, flat: np.ndarray, rate: float) -> Iterator[pa.RecordBatch]:
    """One task's trained weights in parts."""
    model, moments, seen = GatedModel(v, flat), {}, 0
    for _, docs in _chunks(batches, CHUNK_TOKENS):
        seen += model.train(docs, rate, moments)
    if seen:
        parts = [model.flat[i : i + PART].tobytes() for i in range(0, len(model.flat), PART)]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([task] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["task", "chunk", "tokens", "part"])


TRAINED = "task int, chunk int, tokens long, part binary"


def _average(group: pa.Table) -> pa.Table:
    """Mean of one part of some tasks' weights by their tokens, in their order."""
    n = group.column("tokens").to_numpy().astype(np.float64)
    order = np.argsort(group.column("task").to_numpy(), kind="stable")
    parts = group.column("part")
    total = sum(n[i] * np.frombuffer(parts[int(i)].as_py(), np.float32) for i in order) / n.sum()
    return pa.table({"task": pa.array([int(group.column("task").to_numpy().min())], pa.int32()), "chunk": group.column("chunk").slice(0, 1), "tokens": pa.array([int(n.sum())], pa.int64()), "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def average(trained: DataFrame) -> DataFrame:
    """Each part's mean over all tasks, in a tree: a group holds the parts of FAN tasks, or of FAN groups."""
    for level in (FAN, FAN * FAN):
        trained = trained.groupBy("chunk", F.floor(F.col("task") / level).alias("node")).applyInArrow(_average, TRAINED)
    return trained.groupBy("chunk").applyInArrow(_average, TRAINED)


def train(encoded: DataFrame, v: Vocabulary) -> np.ndarray:
    """The weights after all rounds."""
    flat = v.start()
    if not v.total:
        return flat
    for number, (_, rate) in enumerate(ROUNDS):
        begin = flat

        def fit(batches, rate=rate, begin=begin):
            return _fit(batches, v, begin, rate)

        trained = encoded.filter(F.col("round") == number).select("inputs").mapInArrow(fit, TRAINED)
        averaged = average(trained).collect()  # the model's size
        if averaged:
            flat = np.concatenate([np.frombuffer(r.part, np.float32) for r in sorted(averaged, key=lambda r: r.chunk)])
    return flat


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(batches: Iterator[pa.RecordBatch], v: Vocabulary, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    model = GatedModel(v, flat)
    for rows, docs in _chunks(batches, SCORE_TOKENS):
        rows = pa.Table.from_batches(rows)
        scores = (model.score(docs) + rows.column("inner").to_numpy()) / np.log(10)
        columns = [rows.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")]
        yield from pa.table([*columns, pa.array(np.full(len(docs), v.total)), rows.column("base_score"), pa.array(scores)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]).to_batches()


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    encoded, v = encode(docs, scratch_folder(docs.sparkSession, "lm"), block_bytes)
    flat = train(encoded, v)
    return encoded.drop("round").mapInArrow(lambda batches: _score(batches, v, flat), SCORED)
