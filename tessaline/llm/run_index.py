"""Removal of long repeats by a run-length index.

A byte goes if it is covered by a string of LENGTH bytes that also starts in a document with a
smaller doc_id. Texts are UTF-8 bytes; matches never cross documents.

Routing: of the hashes of the 16-byte strings in a window of LENGTH bytes the least is the
window's key, so equal windows have equal keys wherever they stand. Runs of windows with one
key are segments. Documents are dealt to blocks of about BLOCK_BYTES. Each block sends each
of its keys once, with the numbers of its own documents and segments that hold it, to the key's bucket; the bucket
answers with the keys that two documents or more hold. Only segments with such keys travel, one
copy per block and text, to the bucket of their key; of further copies in the same document, only the places travel. A key with more than HOT segments
travels window by window instead, to the bucket of the whole window's hash, so that no
bucket gathers such a family.

Index: of the distinct segments in a bucket, those of a key together, the ones that can remove something (all but
those of the key's greatest document) are indexed: a Burrows-Wheeler transform kept by its runs, with the suffix
positions at both ends of each run as samples and the least doc_id of each interval of suffixes that
share LENGTH bytes. The ones that can lose something (all but those of the key's least document) are
streamed against it from their ends, byte by byte: LF where a row's byte fits, else the nearest run of the byte
above or below, whichever shares more by its sample. Where the match is LENGTH bytes or longer, the interval tells whether
a smaller document holds the window.

Messages between blocks and buckets are only sent where there are keys to send, so their number is bounded by
the keys as well as by blocks times buckets. What a bucket holds of one text is one copy for each
block, whatever its number of copies there.

Defined results: null and empty texts have no bytes; very long texts are handled whole, in one block; rows that share
a doc_id, equal or not, do not remove one another's bytes, each gets its row; of documents with the same string
all but the one with the smallest doc_id lose it; rows with a null doc_id lose nothing and remove nothing; other
columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import shuffle_partitions, text_bytes

LENGTH, GRAM = 50, 16
PARTITIONS = 100_000  # at most, for any number of blocks; a task takes its blocks one by one
BLOCK_BYTES, LEAST_BLOCKS = 8 << 20, 8
HOT = 1 << 16  # occurrences of a key beyond which its windows are dealt one by one
CHUNK = 1 << 17  # bytes of segments in one index; its arrays stay in the cache
LONGEST = 128  # windows in a segment
STRIDE = 1 << 17
NONE = np.iinfo(np.int64).max  # no document
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of size bytes (a power of two), by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    h ^= h >> np.uint64(29)
    have = 1
    while have < size:
        h = h[:-have] * _MIX[1] + h[have:] * _MIX[2]
        h ^= h >> np.uint64(31)
        have *= 2
    return h


def window_keys(data: np.ndarray) -> np.ndarray:
    """The least GRAM hash within each window of LENGTH bytes; one key for each window."""
    n, width = len(data) - LENGTH + 1, LENGTH - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for s in range(0, n, STRIDE):  # small enough to stay in the cache
        e = min(n, s + STRIDE)
        m, have = gram_hashes(data[s : e + LENGTH - 1], GRAM), 1
        while 2 * have <= width:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        if have < width:
            m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
        out[s:e] = m
    return out


class Block:
    """The documents of one block in a fixed order, as one array of bytes, with their segments."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        text = table.column("text").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) and text.num_chunks else text
        text = (text if isinstance(text, pa.Array) else pa.array([], pa.string())).fill_null("")
        self.ids = table.column("doc_id").combine_chunks()
        self.known = ~np.asarray(table.column("doc_id").is_null())
        self.docs = np.asarray(table.column("doc_id").fill_null(0)).astype(np.int64)
        buffers = text.buffers()
        kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
        offsets = np.frombuffer(buffers[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
        raw = np.frombuffer(buffers[2], np.uint8) if len(text) and buffers[2] is not None else np.empty(0, np.uint8)
        self.data = raw[offsets[0] : offsets[-1]]
        self.bounds = offsets - offsets[0]

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, first window, windows, key) of all segments of rows with a doc_id."""
        keys = window_keys(self.data)
        if not len(keys):
            none = np.empty(0, np.int64)
            return none, none, none, np.empty(0, np.uint64)
        new = np.empty(len(keys), bool)
        new[0] = True
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        new[self.bounds[self.bounds < len(keys)]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(keys))
        row = np.searchsorted(self.bounds, starts, side="right") - 1
        last = self.bounds[row + 1] - LENGTH + 1  # behind a row's last window
        fits = (starts < last) & self.known[row]
        starts, ends, row = starts[fits], np.minimum(ends, last)[fits], row[fits]
        count = ends - starts
        pieces = -(-count // LONGEST)
        at = np.repeat(starts, pieces)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = at + nth * LONGEST
        windows = np.minimum(np.repeat(ends, pieces) - at, LONGEST)
        return np.repeat(row, pieces), at, windows, keys[at]


def split_key(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _by_bucket(bucket: np.ndarray, order: np.ndarray):
    """(bucket, rows) for rows ordered by bucket."""
    own = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
    for s, e in zip(cuts, [*cuts[1:], len(own)]):
        yield int(own[s]), order[s:e]


def send_keys(block: int, table: pa.Table, buckets: int) -> pa.Table:
    """(bucket, block, keys, sizes, times): each key of a block once, with the powers of two of its documents and of its segments."""
    own = Block(table)
    row, _, _, key = own.segments()
    doc = own.docs[row]
    order = np.lexsort([doc, key])
    k, d = key[order], doc[order]
    first = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.empty(0, bool)
    fresh = first | np.concatenate([[True], d[1:] != d[:-1]]) if len(k) else first
    starts = np.flatnonzero(first)
    docs = np.add.reduceat(fresh.astype(np.int64), starts) if len(starts) else np.empty(0, np.int64)
    times = np.diff(np.append(starts, len(k)))
    bucket, low = split_key(k[starts], buckets)
    order = np.lexsort([low, bucket])
    power = lambda n: np.ceil(np.log2(n)).astype(np.uint8).tobytes()
    rows = [(b, low[at].tobytes(), power(docs[at]), power(times[at])) for b, at in _by_bucket(bucket, order)]
    sent = {n: pa.array([r[i] for r in rows], pa.binary()) for i, n in ((1, "keys"), (2, "sizes"), (3, "times"))}
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()), **sent})


def answer_keys(bucket: int, table: pa.Table, hot: int) -> pa.Table:
    """(block, bucket, keys, hot): those of each block's keys that two documents hold, and whether they are hot."""
    parts = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("keys")]
    blocks = table.column("block").to_numpy()
    keys = np.concatenate(parts)
    size, times = (np.int64(1) << np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column(c)]).astype(np.int64) for c in ("sizes", "times"))
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    often, load = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    for total, of in ((often, size), (load, times)):
        total[order] = np.repeat(np.add.reduceat(of[order], starts), np.diff(np.append(starts, len(keys))))
    chosen = np.flatnonzero(often >= 2)
    cuts = np.searchsorted(owner[chosen], np.arange(len(parts) + 1))
    out = [chosen[cuts[i] : cuts[i + 1]] for i in range(len(parts))]
    kept = [i for i in range(len(parts)) if len(out[i])]
    return pa.table({"block": pa.array([int(blocks[i]) for i in kept], pa.int32()), "bucket": pa.array([bucket] * len(kept), pa.int32()), "keys": pa.array([keys[out[i]].tobytes() for i in kept], pa.binary()), "hot": pa.array([(load[out[i]] > hot).astype(np.uint8).tobytes() for i in kept], pa.binary())})


SENT = "bucket int, block int, texts binary, lengths binary, docs binary, rows binary, starts binary, keys binary, copies binary"


def _sent(rows: list[tuple]) -> pa.Table:
    names = ["bucket", "block", "texts", "lengths", "docs", "rows", "starts", "keys", "copies"]
    return pa.table({n: pa.array([r[i] for r in rows], pa.int32() if i < 2 else pa.binary()) for i, n in enumerate(names)})


def send_segments(block: int, table: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """Segments with repeated keys, one for each text, with the places (entry, row, start) of its further copies in the same document; and, with null texts, what repeats within the block itself."""
    if not table.num_rows or not answers.num_rows:
        return _sent([])
    own = Block(table)
    row, at, windows, key = own.segments()
    bucket, low = split_key(key, buckets)
    number = bucket.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)
    known, flags = [], []
    for b, keys, hot in zip(answers.column("bucket").to_pylist(), answers.column("keys").to_pylist(), answers.column("hot").to_pylist()):
        known.append(np.uint64(b) << np.uint64(32) | np.frombuffer(keys, np.uint32).astype(np.uint64))
        flags.append(np.frombuffer(hot, np.uint8))
    known, flags = np.concatenate(known), np.concatenate(flags).astype(bool)
    order = np.argsort(known)
    known, flags = known[order], flags[order]
    spot = np.minimum(np.searchsorted(known, number), len(known) - 1)
    chosen = np.flatnonzero(known[spot] == number)
    hot = flags[spot[chosen]]
    if hot.any():  # one segment for each window, by the hash of the whole window
        wide = chosen[hot]
        starts = np.repeat(at[wide], windows[wide]) + np.arange(windows[wide].sum()) - np.repeat(np.cumsum(windows[wide]) - windows[wide], windows[wide])
        whole = gram_hashes(own.data, 32)
        whole = whole[starts] * _MIX[1] + whole[starts + LENGTH - 32] * _MIX[2]
        whole ^= whole >> np.uint64(31)
        row = np.concatenate([row[chosen[~hot]], np.repeat(row[wide], windows[wide])])
        windows = np.concatenate([windows[chosen[~hot]], np.ones(len(starts), np.int64)])
        at = np.concatenate([at[chosen[~hot]], starts])
        key = np.concatenate([key[chosen[~hot]], whole])
        bucket = split_key(key, buckets)[0]
    else:
        row, at, windows, key, bucket = row[chosen], at[chosen], windows[chosen], key[chosen], bucket[chosen]
    data, least, send, marks, place_of, entry, copy = own.data.tobytes(), {}, [], [], {}, [], []
    docs, begin = own.docs[row].tolist(), (at - own.bounds[row]).tolist()
    ends = (at + windows + LENGTH - 1).tolist()
    texts = [data[s:e] for s, e in zip(at.tolist(), ends)]
    for text, doc in zip(texts, docs):
        if least.get(text, doc) >= doc:
            least[text] = doc
    for i, (text, doc) in enumerate(zip(texts, docs)):
        if least[text] < doc:
            marks.append(i)
        elif (first := place_of.setdefault(text, i)) == i:
            send.append(i)
        else:
            entry.append(first)
            copy.append(i)
    entry, copy = np.array(entry, dtype=np.int64), np.array(copy, dtype=np.int64)
    by_entry = np.argsort(entry, kind="stable")
    entry, copy = entry[by_entry], copy[by_entry]
    rows = []
    if marks:
        m = np.array(marks)
        rows.append((block % buckets, block, None, windows[m].astype(np.int32).tobytes(), None, row[m].astype(np.int32).tobytes(), np.array(begin)[m].astype(np.int32).tobytes(), None, None))
    m = np.array(send, dtype=np.int64)
    for b, part in _by_bucket(bucket[m], np.argsort(bucket[m], kind="stable")):
        i = m[part]
        places = lambda j: (row[j].astype(np.int32), (at[j] - own.bounds[row[j]]).astype(np.int32))
        nth, place = _matches(entry, i)
        more = copy[place]
        copies = np.stack([nth.astype(np.int32), *places(more)], axis=1).tobytes() if len(more) else None
        rows.append((b, block, b"".join(texts[j] for j in i), (windows[i] + LENGTH - 1).astype(np.int32).tobytes(), own.docs[row[i]].tobytes(), *(x.tobytes() for x in places(i)), key[i].tobytes(), copies))
    return _sent(rows)


class RunLengthIndex:
    """Run-length Burrows-Wheeler transform of a collection of texts.

    Kept are the runs (start, symbol, where LF sends their first row), the suffix positions of the first and the last
    row of each run (samples), the texts that these point into, and for each row the least doc_id of the
    texts that hold its first length bytes, by runs of equal values too.
    """

    def __init__(self, texts: list[bytes], docs: np.ndarray, length: int = LENGTH):
        self.length = length
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        n = int(sizes.sum()) + len(texts)
        self.symbols = np.zeros(n + length, np.uint16)  # of bytes 1 to 256, of terminators 0, with room behind
        self.symbols[:n] = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        self.symbols[:n] += 1
        self.ends = np.cumsum(sizes + 1) - 1  # places of the terminators
        self.symbols[self.ends] = 0
        self.text_of = np.repeat(np.arange(len(texts)), sizes + 1)
        order, ranks = self._sort(self.symbols[:n].astype(np.uint64), n)
        self._intervals(order, ranks, docs)
        before = self.symbols[order - 1].astype(np.int64)  # of a text's first suffix: a terminator, never followed
        before[order == 0] = 0
        edge = np.concatenate([[True], before[1:] != before[:-1]])
        self.run_start = np.flatnonzero(edge)
        self.run_symbol = before[self.run_start]
        run_length = np.diff(np.append(self.run_start, n))
        self.run_last = self.run_start + run_length - 1
        self.first_sample, self.last_sample = order[self.run_start], order[self.run_last]
        smaller = np.concatenate([[0], np.cumsum(np.bincount(self.symbols[:n], minlength=258))])
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        earlier = np.cumsum(run_length[by_symbol]) - run_length[by_symbol]
        group = np.concatenate([[0], np.cumsum(np.bincount(self.run_symbol, weights=run_length, minlength=258).astype(np.int64))])
        self.target = np.empty(len(self.run_start), np.int64)  # where LF sends the first row of each run
        self.target[by_symbol] = smaller[self.run_symbol[by_symbol]] + earlier - group[self.run_symbol[by_symbol]]
        self.by_symbol = by_symbol  # runs by symbol, for the nearest run of a symbol
        self.by_symbol_key = self.run_symbol[by_symbol] * len(self.run_start) + by_symbol
        del self.text_of, self.ends

    def _sort(self, symbols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Suffix order by prefix doubling, and the ranks of all suffixes by 32 symbols (None if fewer tell all apart)."""
        packed = symbols
        for have in range(1, 4):  # symbols of 9 bits before what follows them; a terminator is followed by nothing
            following = np.append(packed[1:], np.uint64(0))
            following[symbols == 0] = 0
            packed = symbols << np.uint64(9 * have) | following
        order, rank = self._rank(packed, n)
        have, kept, texts = 4, None, len(self.ends)
        left = self.ends[self.text_of] - np.arange(n)  # symbols before the terminator
        while True:
            if have == 32:
                kept = rank
            if have >= 32 and int(rank.max()) == n - 1:
                break
            ahead = np.minimum(np.arange(n) + have, n - 1)
            second = np.where(left >= have, rank[ahead] + texts, self.text_of)
            if n + texts < 1 << 21:
                order, rank = self._rank(rank.astype(np.uint64) << np.uint64(21) | second.astype(np.uint64), n)
            else:
                order = np.lexsort([second, rank])
                a, b = rank[order], second[order]
                new = np.concatenate([[False], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                rank = np.empty(n, np.int64)
                rank[order] = np.cumsum(new)
            have *= 2
        return order, kept

    @staticmethod
    def _rank(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n < 1 << 21 and int(keys.max()) < 1 << 42:
            both = np.sort(keys << np.uint64(21) | np.arange(n, dtype=np.uint64))
            order = (both & np.uint64((1 << 21) - 1)).astype(np.int64)
            both >>= np.uint64(21)
        else:
            order = np.argsort(keys, kind="stable")
            both = keys[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], both[1:] != both[:-1]]))
        return order, rank

    def _intervals(self, order: np.ndarray, ranks: np.ndarray, docs: np.ndarray) -> None:
        """The least document of each interval of suffixes that share length symbols; NONE where a suffix is shorter."""
        fits = (self.ends[self.text_of[order]] - order) >= self.length
        a, b = order[:-1], order[1:]
        shift = self.length - 32
        same = fits[:-1] & fits[1:] & (ranks[a] == ranks[b])
        some = np.flatnonzero(same)
        same[some] = ranks[a[some] + shift] == ranks[b[some] + shift]
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        least = np.where(fits[first], np.minimum.reduceat(docs[self.text_of[order]], first), NONE)
        change = np.concatenate([[True], least[1:] != least[:-1]])
        self.least_start, self.least = first[change], least[change]

    def shared(self, at: np.ndarray, queries: np.ndarray, places: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols from at in the index's texts and from places in the queries agree, up to most. Most pairs differ early."""
        out = np.zeros(len(at), np.int64)
        for s in range(0, len(at), 1 << 15):
            left, done = s + np.flatnonzero(most[s : s + (1 << 15)] > 0), 0
            for upto in (4, 16, self.length):
                span = np.arange(done, upto)
                differ = self.symbols[at[left, None] + span] != queries[places[left, None] + span]
                ends = differ.any(axis=1)
                out[left] = np.where(ends, done + differ.argmax(axis=1), upto)
                left, done = left[~ends & (most[left] > upto)], upto
                if not len(left):
                    break
        return np.minimum(out, most)

    def stream(self, queries: list[bytes]):
        """Matching statistics of all queries, from their ends, all at once: yields (queries, offsets, least document that holds the window there, NONE for no document).

        Each query has a row of the transform and how many symbols it shares with the row's suffix, up to length. If
        the row's symbol is the query's next one, LF follows it. If not, the last row of the run of that symbol above and
        the first row of the one below are the candidates; their samples tell which of them shares more.
        """
        sizes = np.array([len(q) for q in queries], dtype=np.int64)
        live = np.argsort(-sizes, kind="stable")
        ordered = sizes[live]
        data = np.zeros(int(sizes.sum()) + self.length, np.uint16)
        data[: len(data) - self.length] = np.frombuffer(b"".join(queries), np.uint8)
        data += 1
        begin = (np.cumsum(sizes) - sizes)[live]
        runs, row, have = len(self.run_start), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for read in range(1, int(ordered.max(initial=0)) + 1):
            n = int(np.searchsorted(-ordered, -read, side="right"))
            row, have = row[:n], have[:n]
            place = begin[:n] + ordered[:n] - read
            symbol = data[place].astype(np.int64)
            run = np.searchsorted(self.run_start, row, side="right") - 1
            follows = (self.run_symbol[run] == symbol) & (have > 0)
            next_row = self.target[run] + row - self.run_start[run]
            next_have = have + 1
            jump = np.flatnonzero(~follows)
            if len(jump):
                below = np.searchsorted(self.by_symbol_key, symbol[jump] * runs + run[jump])
                after, most = place[jump] + 1, np.minimum(have[jump], self.length - 1)
                best = np.full(len(jump), -1)
                for near, last in ((np.maximum(below - 1, 0), True), (np.minimum(below, runs - 1), False)):
                    own = self.by_symbol[near]
                    fits = np.flatnonzero((self.run_symbol[own] == symbol[jump]) & (best < most))  # nothing shares more than most
                    sample = (self.last_sample if last else self.first_sample)[own[fits]]
                    found = np.full(len(jump), -1)
                    found[fits] = self.shared(sample, data, after[fits], most[fits])
                    better = found > best
                    best[better] = found[better]
                    there = self.target[own] + ((self.run_last - self.run_start)[own] if last else 0)
                    next_row[jump[better]] = there[better]
                next_have[jump] = best + 1
                next_row[jump[best < 0]] = 0
            row, have = next_row, np.minimum(next_have, self.length)
            whole = np.flatnonzero(have >= self.length)
            if len(whole):
                yield live[whole], ordered[whole] - read, self.least[np.searchsorted(self.least_start, row[whole], side="right") - 1]


def _repeated_runs(texts: list[bytes], docs: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows) of each run of windows that also start in a smaller document.

    least and most are the extreme documents of a text's key: a text of the greatest document removes nothing and is not
    indexed, one of the least loses nothing and is not asked for.
    """
    indexed, asked = np.flatnonzero(docs < most), np.flatnonzero(docs > least)
    index = RunLengthIndex([texts[i] for i in indexed], docs[indexed])
    sizes = np.array([len(texts[i]) for i in asked], dtype=np.int64)
    room = sizes - LENGTH + 2  # windows, and a gap
    offset = np.cumsum(room) - room
    hit = np.zeros(int(room.sum()) + 1, bool)
    for who, where, found in index.stream([texts[i] for i in asked]):
        smaller = found < docs[asked[who]]
        hit[offset[who[smaller]] + where[smaller]] = True
    edge = np.diff(np.concatenate([[False], hit]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.searchsorted(offset, start, side="right") - 1
    return asked[text], start - offset[text], end - start


def _matches(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all wanted[i] == ordered[j]."""
    low = np.searchsorted(ordered, wanted)
    times = np.searchsorted(ordered, wanted, side="right") - low
    i = np.repeat(np.arange(len(wanted)), times)
    return i, np.repeat(low, times) + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)


def mark_repeats(table: pa.Table, chunk: int) -> pa.Table:
    """(block, rows, starts, windows): runs of windows to remove."""
    texts: list[bytes] = []
    columns: list[list[np.ndarray]] = [[], [], [], [], []]  # block, doc, row, start, key
    further: list[np.ndarray] = [np.empty((0, 3), np.int64)]  # entry, row, start of further copies
    entries = 0
    found: list[tuple[np.ndarray, ...]] = []  # block, row, start, windows
    for r in table.to_pylist():
        lengths, rows, starts = (np.frombuffer(r[c], np.int32) for c in ("lengths", "rows", "starts"))
        block = np.full(len(lengths), r["block"], np.int32)
        if r["texts"] is None:  # repeats within the block, for its own use
            found.append((block, rows, starts, lengths))
            continue
        if r["copies"] is not None:
            further.append(np.frombuffer(r["copies"], np.int32).reshape(-1, 3).astype(np.int64) + [entries, 0, 0])
        entries += len(lengths)
        cuts = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        texts += [r["texts"][s:e] for s, e in zip(cuts[:-1], cuts[1:])]
        for column, part in zip(columns, (block, np.frombuffer(r["docs"], np.int64), rows, starts, np.frombuffer(r["keys"], np.uint64))):
            column.append(part)
    if texts:
        blocks, docs, rows, starts, keys = map(np.concatenate, columns)
        number: dict[bytes, int] = {}
        of = np.fromiter((number.setdefault(t, len(number)) for t in texts), dtype=np.int64, count=len(texts))
        distinct = list(number)
        sizes = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct))
        least = np.full(len(distinct), NONE)
        np.minimum.at(least, of, docs)
        key = np.empty(len(distinct), np.uint64)
        key[of] = keys
        whole = docs > least[of]  # a smaller document holds all of the segment
        gone = [(np.flatnonzero(whole), np.zeros(int(whole.sum()), np.int64), sizes[of[whole]] - LENGTH + 1)]  # entry, first window, windows

        order = np.argsort(key, kind="stable")
        first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        begins = np.flatnonzero(first)
        low, high = (f.reduceat(least[order], begins)[np.cumsum(first) - 1] for f in (np.minimum, np.maximum))
        alone = low == high  # all texts of a key in one document: nothing to match
        order, first, low, high = order[~alone], first[~alone], low[~alone], high[~alone]
        ends = np.cumsum(sizes[order])
        begins = np.flatnonzero(first)
        runs: list[tuple[np.ndarray, ...]] = []
        at = 0
        while at < len(order):
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, side="right"))
            later = int(np.searchsorted(begins, max(stop, at + 1)))  # up to the end of a key
            stop = int(begins[later]) if later < len(begins) else len(order)
            batch = order[at:stop]
            text, start, windows = _repeated_runs([distinct[i] for i in batch], least[batch], low[at:stop], high[at:stop])
            runs.append((batch[text], start, windows))
            at = stop
        if runs:
            text, start, windows = map(np.concatenate, zip(*runs))
            own = np.flatnonzero(~whole)
            own = own[np.argsort(of[own], kind="stable")]
            run, place = _matches(of[own], text)
            gone.append((own[place], start[run], windows[run]))
        entry, start, windows = map(np.concatenate, zip(*gone))
        found.append((blocks[entry], rows[entry], (starts[entry] + start).astype(np.int32), windows.astype(np.int32)))
        copies = np.concatenate(further)  # of every entry in order
        run, place = _matches(copies[:, 0], entry)
        found.append((blocks[entry[run]], copies[place, 1].astype(np.int32), (copies[place, 2] + start[run]).astype(np.int32), windows[run].astype(np.int32)))
    out = []
    if found:
        blocks, *rest = map(np.concatenate, zip(*found))
        for block, at in _by_bucket(blocks, np.argsort(blocks, kind="stable")):
            out.append((block, *(x[at].astype(np.int32).tobytes() for x in rest)))
    return pa.table({n: pa.array([o[i] for o in out], pa.binary() if i else pa.int32()) for i, n in enumerate(["block", "rows", "starts", "windows"])})


def remove_marked(table: pa.Table, marks: pa.Table) -> pa.Table:
    """The result row of each document of a block, with the kept bytes."""
    own = Block(table)
    change = np.zeros(len(own.data) + 1, np.int32)
    for rows, starts, windows in zip(*(marks.column(c).to_pylist() for c in ("rows", "starts", "windows"))):
        at = own.bounds[np.frombuffer(rows, np.int32)] + np.frombuffer(starts, np.int32)
        np.add.at(change, at, 1)
        np.add.at(change, at + np.frombuffer(windows, np.int32) + LENGTH - 1, -1)
    gone = np.cumsum(change[:-1], dtype=np.int32) > 0
    removed, spans, kept = [], [], []
    for s, e in zip(own.bounds[:-1].tolist(), own.bounds[1:].tolist()):
        mask = gone[s:e]
        n = int(mask.sum())
        removed.append(n)
        spans.append(int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if n else 0)
        kept.append((own.data[s:e][~mask] if n else own.data[s:e]).tobytes())
    return pa.table({"doc_id": own.ids, "n_bytes": pa.array(np.diff(own.bounds)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    blocks = max(LEAST_BLOCKS, -(-text_bytes(docs) // block_bytes))
    buckets = blocks
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    dealt = own.repartition(min(max(blocks, shuffle_partitions(docs.sparkSession)), PARTITIONS), "block")  # one exchange, read three times

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        return send_keys(key[0].as_py(), table, buckets)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        return answer_keys(key[0].as_py(), table, hot)

    def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return send_segments(key[0].as_py(), left, right, buckets)

    def mark(table: pa.Table) -> pa.Table:
        return mark_repeats(table, chunk)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        return remove_marked(left, right)

    asked = dealt.groupBy("block").applyInArrow(ask, "bucket int, block int, keys binary, sizes binary, times binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, keys binary, hot binary")
    sent = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(send, SENT)
    marks = sent.groupBy("bucket").applyInArrow(mark, "block int, rows binary, starts binary, windows binary")
    return dealt.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
