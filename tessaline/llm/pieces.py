"""SentencePiece encoding and decoding by a shared-prefix forward pass.

Texts become words marked with U+2581, which no piece of such a model crosses. The distinct
words of a portion are sorted, which lists the leaves of their trie depth-first, and encoded
with a stack of forward states, one for each character of the current word: the next word
keeps the states of the prefix that it shares and computes only the rest. An automaton over
the pieces names those that end at each character.

A unigram model's state is the best score of a prefix and the piece that ends it (Viterbi;
of equal scores the longest last piece). For a BPE model the best sum of scores is not what the
model encodes, so its state is the last piece of the prefix's encoding: of the pieces that end
there, the one that BPE leaves next to the last piece before it. Both states depend on the
prefix alone. Characters without a piece become byte pieces. The only model to hand is a BPE
model, so the query runs the second state; the tests compare the first with brute force.

Defined results: null and empty texts have no pieces; U+2581 in a text decodes as a
space, as in the library; very long texts are encoded whole, in a portion of their own; repeated
rows get a row each; other columns are ignored, whatever their names; an empty table works.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
CACHED_WORDS, CACHED_PAIRS = 250_000, 300_000  # a worker forgets its words and pairs beyond so many; results do not depend on it
PORTION = 2 << 20  # characters


class Automaton:
    """For every text, the pieces that end where it ends: states are prefixes of pieces, and a character leads from the longest that ends a text to the next."""

    def __init__(self, ids: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        ends: list[tuple[int, int] | None] = [None]
        for piece, i in ids.items():
            state = 0
            for c in piece:
                state = self.next[state].setdefault(c, len(self.next))
                if state == len(self.next):
                    self.next.append({})
                    ends.append(None)
            ends[state] = (len(piece), i)
        self.shorter = [0] * len(self.next)  # the longest proper suffix that is a state
        self.found: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)  # (length, id) of the pieces that end here, longest first
        level = list(self.next[0].values())
        for state in level:
            self.found[state] = (ends[state],) if ends[state] else ()
        while level:
            deeper = []
            for state in level:
                for c, after in self.next[state].items():
                    deeper.append(after)
                    at = self.shorter[state]
                    while at and c not in self.next[at]:
                        at = self.shorter[at]
                    at = self.next[at].get(c, 0)
                    self.shorter[after] = at
                    self.found[after] = (ends[after], *self.found[at]) if ends[after] else self.found[at]
            level = deeper
        self.learnt: dict[tuple[int, str], int] = {}

    def step(self, state: int, c: str) -> int:
        """Where c leads if the state itself does not continue with it."""
        known = self.learnt.get((state, c))
        if known is None:
            at = state
            while at and c not in self.next[at]:
                at = self.shorter[at]
            known = self.next[at].get(c, 0)
            if len(self.learnt) < CACHED_PAIRS:
                self.learnt[state, c] = known
        return known


class _Numbers(dict):
    """Numbers words as they come; fresh lists those that are not encoded yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


class Pieces:
    """A SentencePiece vocabulary with its forward pass."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind, self.ids, self.scores, self.bytes_of, byte_ids = kind, {}, {}, [], {}
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
                byte_ids[int(piece[3:5], 16)] = i
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b" \xe2\x81\x87 " if model.is_unknown(i) else b"")
            else:
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                self.ids[piece] = i
                self.scores[piece] = model.get_score(i)
        self.names = {i: piece for piece, i in self.ids.items()}
        self.score_of = {i: self.scores[piece] for piece, i in self.ids.items()}
        self.byte_sizes = np.array([len(b) for b in self.bytes_of], dtype=np.int32)
        self.byte_begins = np.cumsum(self.byte_sizes, dtype=np.int32) - self.byte_sizes
        self.byte_data = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.byte_ids = [byte_ids[b] for b in range(256)]
        self.automaton = Automaton(self.ids)
        self.lowest = min(self.scores.values(), default=0.0) - 10.0
        self.run = max((len(p) for p in self.ids if not p.strip(MARK)), default=1)  # marks in the longest piece of marks
        self.runs = [model.encode(" " * (n - 1)) for n in range(1, 2 * self.run + 1)]  # by marks; the text's first mark is added
        self.runs[0] = [self.ids[MARK]]
        self.beside: dict[int, bool] = {}  # by the left id, shifted, and the right id
        self.forget()

    def merged(self, text: str) -> list[str]:
        """BPE by definition, for two short pieces."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stays_beside(self, left: int, right: int) -> bool:
        """Whether BPE leaves two pieces as they are; kept in beside."""
        if len(self.beside) > CACHED_PAIRS:
            self.beside.clear()
        a, b = self.names[left], self.names[right]
        known = self.beside[left << 24 | right] = self.merged(a + b) == [a, b]
        return known

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words, visited in the order of their trie.

        The forward states of a word's prefixes are lists by the prefix's length: the automaton's state, the start
        of the last piece, that piece (-1 for a character without one), and for a unigram model its score.
        """
        follow, found, step, known, bpe, score_of = self.automaton.next, self.automaton.found, self.automaton.step, self.beside.get, self.kind == "bpe", self.score_of
        states, starts, pieces, totals = [0], [0], [-1], [0.0]
        out: dict[str, list[int]] = {}
        previous = ""
        for word in sorted(words):
            shared, most = 0, min(len(previous), len(word))
            while shared < most and previous[shared] == word[shared]:
                shared += 1
            keep = shared + 1
            del states[keep:], starts[keep:], pieces[keep:]
            state = states[-1]
            if not bpe:
                del totals[keep:]
            for end in range(keep, len(word) + 1):
                c = word[end - 1]
                state = follow[state][c] if c in follow[state] else step(state, c)
                start, best = end - 1, -1
                if bpe:
                    for n, piece in found[state]:
                        before = pieces[end - n]
                        if before >= 0:
                            beside = known(before << 24 | piece)
                            if not (self.stays_beside(before, piece) if beside is None else beside):
                                continue
                        start, best = end - n, piece
                        break
                else:
                    total = totals[end - 1] + self.lowest
                    for n, piece in found[state]:
                        if best < 0 or totals[end - n] + score_of[piece] > total:
                            start, best, total = end - n, piece, totals[end - n] + score_of[piece]
                    totals.append(total)
                states.append(state)
                starts.append(start)
                pieces.append(best)
            own, end = [], len(word)
            while end:
                piece = pieces[end]
                if piece < 0:
                    own.extend(self.byte_ids[b] for b in reversed(word[end - 1 : end].encode()))
                else:
                    own.append(piece)
                end = starts[end]
            own.reverse()
            out[word] = own
            previous = word
        return out

    def encode_marked(self, words: list[str]) -> list[list[int]]:
        """Ids of marked words. Of several marks in a row BPE joins the last to the word first and the others at the end: longest pieces, then the rest."""
        if self.kind != "bpe":
            ids = self.encode_words(words)
            return [ids[w] for w in words]
        several = {w: MARK + w.lstrip(MARK) for w in words if w.startswith(MARK * 2)}
        ids = self.encode_words(list({several.get(w, w) for w in words} if several else words))
        for word, single in several.items():
            marks, own = len(word) - len(single) + 1, ids[single]
            alone = own[0] == self.ids.get(MARK)
            left = marks if alone else marks - 1
            whole = max(0, -(-left // self.run) - 2)
            ids[word] = [self.ids[MARK * self.run]] * whole + self.runs[left - whole * self.run - 1] + own[alone:]
        return [ids[w] for w in words]

    def words_of(self, text: str) -> list[str]:
        """A text's words: what follows one mark without it, what follows several with all of them."""
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [w if w.startswith(MARK * 2) else w[1:] for w in WORDS.findall(MARK + text.replace(" ", MARK))]

    def learn(self) -> None:
        """Encode the fresh words and keep their ids in one array."""
        parts = self.encode_marked([w if w.startswith(MARK * 2) else MARK + w for w in self.number.fresh])
        self.number.fresh = []
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        self.sizes = np.concatenate([self.sizes, sizes])
        self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(parts), dtype=np.int32, count=int(sizes.sum()))])

    def forget(self) -> None:
        self.number = _Numbers()
        self.sizes, self.begins, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and their number for each text."""
        if len(self.number) > CACHED_WORDS:
            self.forget()
        split = [self.words_of(t) for t in texts]
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(counts.sum()))
        if self.number.fresh:
            self.learn()
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(self.begins[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        totals = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return flat, np.diff(totals)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        flat, sizes = self.encode_batch(texts)
        return np.split(flat, np.cumsum(sizes)[:-1]) if len(texts) else []

    def decode_batch(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each text from all ids in one array and their number for each text, without the first mark's space."""
        lengths = self.byte_sizes[flat]
        ends = np.cumsum(lengths, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if total < 1 << 30 else np.int64
        place = np.arange(total, dtype=kind)
        place += np.repeat((self.byte_begins[flat] - (ends - lengths)).astype(kind), lengths)
        data = self.byte_data[place].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [data[s + 1 : e] for s, e in zip(cuts[:-1], cuts[1:])]

    def round_trips(self, flat: np.ndarray, sizes: np.ndarray, texts: list[str]) -> list[bool]:
        """Whether the ids of each text decode to it."""
        return [d == t.replace(MARK, " ").encode() for d, t in zip(self.decode_batch(flat, sizes), texts)]

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        return self.decode_batch(ids, np.array([len(ids)]))[0].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def pieces(path: str, kind: str) -> Pieces:
    return Pieces(path, kind)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows with texts of about PORTION characters together."""
    for batch in batches:
        column, texts, begin, size = batch.column(1), [], 0, 0
        for i in range(batch.num_rows):
            texts.append(column[i].as_py() or "")
            size += len(texts[-1])
            if size >= PORTION or i == batch.num_rows - 1:
                yield batch.slice(begin, len(texts)), texts
                texts, begin, size = [], i + 1, 0


def _encode(batches: Iterator[pa.RecordBatch], path: str, kind: str) -> Iterator[pa.RecordBatch]:
    model = pieces(path, kind)
    for batch, texts in _portions(batches):
        flat, sizes = model.encode_batch(texts)
        same = model.round_trips(flat, sizes, texts)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(same)], ["doc_id", "n_pieces", "ids", "round_trip"])


def _decode(batches: Iterator[pa.RecordBatch], path: str, kind: str) -> Iterator[pa.RecordBatch]:
    model = pieces(path, kind)
    for batch in batches:
        texts = [model.decode(np.array(i or [], dtype=np.int64)) for i in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip): round_trip tells whether decoding gives the text again."""
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(partial(_encode, path=path, kind=kind), f"doc_id {dict(docs.dtypes)['doc_id']}, n_pieces long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, path=path, kind=kind), f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")
