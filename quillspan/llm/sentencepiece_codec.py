"""SentencePiece encoding and decoding by streaming Viterbi."""

from __future__ import annotations

import codecs
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, beside, kept, slices
from .piece_model import BPE, BYTE, CONTROL, SPACE, UNKNOWN, UNUSED, PieceModel
from .token_counts import merge

codecs.register_error("quillspan_each_byte", lambda e: ("�" * (e.end - e.start), e.end))
#: Bytes of text that a worker encodes or decodes at a time, and characters of segments it remembers.
BATCH_BYTES, MEMO_CHARS = 3_000_000, 48


class StreamingViterbi:
    """Shortest paths over piece boundaries, kept in a window of the longest piece.

    Each boundary keeps one backpointer. A unigram model keeps the path of the highest score. A
    byte-pair model keeps the one path that merging would leave: a piece may follow another only if
    merging the two alone leaves both as they are, and exactly one piece ending at a boundary passes
    that, so the path equals the library's ids.

    An automaton of the pieces reads the characters. Its state tells which pieces end at a boundary and
    which boundaries survive: the newest one, and those from which the characters read so far begin a
    longer piece. Survivors lie in a window of the longest piece. Ids are committed at once where one
    boundary survives, and in a full window where the paths of all survivors meet; only what follows the
    committed boundary is kept. A segment between two places that no piece crosses (found by a pattern,
    one boundary survives there) depends on its own characters alone, so its ids are remembered.

    Symbols are piece ids; a character outside the inventory is -1 minus its code point."""

    def __init__(self, model: PieceModel, memo: int = 250_000):
        self.model, self._find = model, model.chunk_pattern.findall
        # ids are kept as the bytes of 32-bit integers: small, and joined without a list
        self._memo: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._cap = memo
        self._follows = Memo(lambda key: self._stable((self._name(key // len(model.pieces)), model.pieces[key % len(model.pieces)])), 200_000, 0)
        self._bytes = [array("i", [i]).tobytes() for i in range(len(model.pieces))]
        self._sizes = [len(p) for p in model.pieces]
        self._unk_score = min(model.scores, default=0.0) - 10.0
        self._rank = model.rank() if model.kind == BPE else {}
        self._last_merge: dict[str, tuple[str, str]] = {}  # of pieces made by merges of ever higher rank
        # the automaton: state 1 has read nothing; what a state tells is worked out when it is first met
        self._next: list[dict[str, int]] = [{}, {}]
        self._fail, self._depth, self._piece = [0, 1], [0, 0], [None, None]
        for piece in sorted(model.ids, key=len):
            if len(piece) > 1 and (self._made(piece) if model.kind == BPE else model.types[model.ids[piece]] != UNUSED):
                self._add(piece, model.ids[piece])
        self._link()

    def _add(self, piece: str, i: int) -> None:
        state = 1
        for char in piece:
            to = self._next[state].get(char)
            if to is None:
                to = self._next[state][char] = len(self._next)
                self._next.append({})
                self._fail.append(1)
                self._depth.append(self._depth[state] + 1)
                self._piece.append(None)
            state = to
        self._piece[state] = i

    def _link(self) -> None:
        """Per state, from the root on: where to go on after a mismatch, pieces that end here (the
        longest first) and lengths after which a longer piece may go on."""
        self._ends, self._alive = [()] * len(self._next), [()] * len(self._next)
        level = [1]
        while level:
            below = []
            for state in level:
                fail, depth = self._fail[state], self._depth[state]
                if depth:
                    here = ((depth, self._piece[state]),) if self._piece[state] is not None else ()
                    self._ends[state] = here + self._ends[fail]
                    self._alive[state] = ((depth,) if self._next[state] else ()) + self._alive[fail]
                for char, to in self._next[state].items():
                    if depth:
                        at = fail
                        while at != 1 and char not in self._next[at]:
                            at = self._fail[at]
                        self._fail[to] = self._next[at].get(char, 1)
                    below.append(to)
            level = below
        self._go = [dict(follow) for follow in self._next]

    def _read(self, state: int, char: str) -> int:
        """The state after a character, remembered for characters of the inventory."""
        at = state
        while at != 1 and char not in self._next[at]:
            at = self._fail[at]
        to = self._next[at].get(char, 1)
        if char in self.model.chars:
            self._go[state][char] = to
        return to

    def _made(self, piece: str) -> bool:
        """Whether merging makes this piece out of its characters; notes its last merge."""
        rank = self._rank
        if merge(piece, rank)[1][0] != len(piece):
            return False
        without = {k: v for i in range(len(piece)) for j in range(i + 2, len(piece) + 1) if (k := piece[i:j]) != piece and (v := rank.get(k)) is not None}
        cut = next(i for i, n in enumerate(merge(piece, without)[1]) if i and n)
        left, right = piece[:cut], piece[cut:]
        if all(len(x) == 1 or x in self._last_merge and rank[x] < rank[piece] for x in (left, right)):
            self._last_merge[piece] = left, right
        return True

    def _stable(self, pair: tuple[str, str]) -> bool:
        """Whether merging left + right leaves both.

        Undoes the merges of both, the latest first (of equal ranks the right one), and looks each
        time whether the two symbols that touch would have merged before the merge just undone."""
        left, right = pair
        rank, last = self._rank, self._last_merge
        if any(len(x) > 1 and x not in last for x in pair):  # ranks out of order: merge the pair
            size = merge(left + right, rank)[1]
            return size[0] == len(left) and size[len(left)] == len(right)
        limit = float("inf")
        while True:
            both = rank.get(left + right)
            if both is not None and both <= limit:
                return False
            r, s = rank.get(left, -1) if len(left) > 1 else -1, rank.get(right, -1) if len(right) > 1 else -1
            if len(left) == len(right) == 1:
                return True
            if len(right) == 1 or len(left) > 1 and r > s:
                limit, left = r - 0.5, last[left][1]
            else:
                limit, right = s, last[right][0]

    def _name(self, symbol: int) -> str:
        return self.model.pieces[symbol] if symbol >= 0 else chr(-1 - symbol)

    def _coded(self, symbol: int) -> bytes:
        """The ids of a symbol: itself, or its UTF-8 bytes or the unknown id where it has none."""
        if symbol >= 0:
            return self._bytes[symbol]
        if self.model.byte_fallback and self.model.byte_ids:
            return b"".join(self._bytes[self.model.byte_ids[b]] for b in self._name(symbol).encode())
        return self._bytes[self.model.unk_id]

    def commits(self, text: Iterable[str]) -> Iterator[list[int]]:
        """Symbols of a stream of characters, in lists, each given out as soon as it is certain."""
        window = Window(self)
        for char in text:
            window.read(char)
            if window.done:
                yield window.done
                window.done = []
        yield window.path(len(window.last) - 1)

    def pieces(self, text: Iterable[str]) -> Iterator[str]:
        """Pieces of a stream of characters."""
        for symbols in self.commits(text):
            yield from map(self._name, symbols)

    def _in_order(self, segments: list[str]) -> Iterator[bytes]:
        """Ids of sorted segments; what the window still holds of a common beginning is not read again."""
        window, before = Window(self), ""
        for text in segments:
            same = 0
            for a, b in zip(before, text, strict=False):
                if a != b:
                    break
                same += 1
            window.read(text[window.back(same) :])
            symbols = window.path(len(window.last) - 1)
            if window.done:
                symbols = window.done + symbols
            yield array("i", symbols).tobytes() if min(symbols) >= 0 else b"".join(map(self._coded, symbols))
            before = text

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; segments that are new in them are encoded together.

        Segments are remembered in two generations, so that memory stays bounded; very long ones are not."""
        segments = [self._find(self.model.normalised(text)) if text else () for text in texts]
        memo, old = self._memo, self._old
        missing = set().union(*segments) - memo.keys()
        again = missing & old.keys()
        memo.update(zip(again, map(old.__getitem__, again), strict=True))
        new = sorted(missing - again)
        memo.update(zip(new, self._in_order(new), strict=True))
        out = [np.frombuffer(b"".join(map(memo.__getitem__, found)), np.int32) for found in segments]
        for segment in new:
            if len(segment) > MEMO_CHARS:
                del memo[segment]
        if len(memo) > self._cap:
            self._old, self._memo = memo, {}
        return out


class Window:
    """What is kept of a stream: committed symbols, and from the last committed boundary on each
    boundary's backpointer (the symbol that ends there), automaton state and, for unigrams, score."""

    __slots__ = ("viterbi", "base", "since", "done", "last", "states", "score")

    def __init__(self, viterbi: StreamingViterbi):
        self.viterbi = viterbi
        self.restart()

    def restart(self) -> None:
        self.base = self.since = 0  # the committed boundary, and how far was read when it was
        self.done, self.states = [], [1]
        self.last: list[int | None] = [None]
        self.score = [0.0]

    def back(self, boundary: int) -> int:
        """Forget what follows a boundary, or all if something after it led to a commit; where to read on."""
        if boundary < self.since:
            self.restart()
            return 0
        at = boundary - self.base + 1
        del self.last[at:], self.states[at:], self.score[at:]
        return boundary

    def read(self, chars: str) -> None:
        v = self.viterbi
        ids, byte_pair, width, many = v.model.ids, v.model.kind == BPE, v.model.max_len, len(v.model.pieces)
        go, ends, alive, follows, scores = v._go, v._ends, v._alive, v._follows, v.model.scores
        last, states, score = self.last, self.states, self.score
        state, end = states[-1], len(last) - 1
        for char in chars:
            end += 1
            state = go[state].get(char) or v._read(state, char)
            states.append(state)
            if byte_pair:
                for n, piece in ends[state]:
                    before = last[end - n]
                    if before is None or follows[before * many + piece]:
                        last.append(piece)
                        break
                else:
                    last.append(ids.get(char, -1 - ord(char)))
            else:
                i = ids.get(char)
                best, best_score = (-1 - ord(char), score[-1] + v._unk_score) if i is None else (i, score[-1] + scores[i])
                for n, piece in ends[state]:
                    if (s := score[end - n] + scores[piece]) > best_score:
                        best, best_score = piece, s
                last.append(best)
                score.append(best_score)
            if not alive[state] or end > width:
                meet = self._meet(end, alive[state]) if alive[state] else end
                if meet:
                    self.done += self.path(meet)
                    self.since = self.base + end
                    self.base += meet
                    end -= meet
                    self.last, self.states = last, states = last[meet:], states[meet:]
                    if not byte_pair:
                        self.score = score = [x - score[meet] for x in score[meet:]]

    def path(self, at: int) -> list[int]:
        """Symbols from the committed boundary to a boundary of the window."""
        out, last, sizes = [], self.last, self.viterbi._sizes
        while at:
            symbol = last[at]
            out.append(symbol)
            at -= sizes[symbol] if symbol >= 0 else 1
        out.reverse()
        return out

    def _meet(self, end: int, lengths: tuple[int, ...]) -> int:
        """The last boundary that the paths of all surviving boundaries go through."""
        last, sizes, alive = self.last, self.viterbi._sizes, {end, *(end - n for n in lengths)}
        while len(alive) > 1:
            top = max(alive)
            alive.discard(top)
            symbol = last[top]
            alive.add(top - (sizes[symbol] if symbol >= 0 else 1))
        return alive.pop()


class Decoder:
    """Ids back to text: space marks become spaces and byte pieces bytes, each invalid byte U+FFFD.

    An id outside the inventory gives U+FFFD, a null id nothing."""

    def __init__(self, model: PieceModel):
        self.dummy_prefix, self.n = model.dummy_prefix, len(model.pieces)
        self.bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(model.pieces, model.types, strict=True)]

    def _named(self, i: int | None) -> bytes:
        return b"" if i is None else self.bytes[i] if 0 <= i < self.n else "�".encode()

    def decode(self, ids) -> str:
        out = b"".join(map(self._named, ids))
        return (out[1:] if self.dummy_prefix and out.startswith(b" ") else out).decode("utf-8", "quillspan_each_byte")

    def decode_known(self, ids: np.ndarray) -> str:
        """decode() for ids of the inventory."""
        out = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return (out[1:] if self.dummy_prefix and out.startswith(b" ") else out).decode("utf-8", "quillspan_each_byte")


@lru_cache(maxsize=2)
def _viterbi(path: str) -> StreamingViterbi:
    return StreamingViterbi(PieceModel.load(path))


@lru_cache(maxsize=2)
def _decoder(path: str) -> Decoder:
    return Decoder(PieceModel.load(path))


def _small(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The same rows in batches of about BATCH_BYTES, so that the memory of a worker does not grow with the batch."""
    for batch in batches:
        for a, b in slices(len(batch), pc.fill_null(pc.binary_length(batch), 0).to_pylist(), BATCH_BYTES):
            yield batch.slice(a, b - a)


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))


def encode(text: Column, model_path: str) -> Column:
    """array<int> of piece ids without begin or end; null and empty text give an empty array."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        viterbi = _viterbi(model_path)
        for batch in _small(batches):
            yield _lists(viterbi.encode_all(batch.to_pylist()))

    return ids(text)


def decode(ids: Column, model_path: str) -> Column:
    """Text of an array<int>; null gives an empty text, an id outside the inventory U+FFFD, a null id nothing."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _decoder(model_path)
        for batch in batches:
            yield pa.array([decoder.decode(row.as_py() or ()) for row in batch], pa.string())

    return text(ids)


def _code(text: Column, model_path: str) -> Column:
    """ids and, decoded from them, the text again, in one worker: ids cross to Python only once."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        viterbi, decoder = _viterbi(model_path), _decoder(model_path)
        for batch in _small(batches):
            found = viterbi.encode_all(batch.to_pylist())
            back = pa.array([decoder.decode_known(x) for x in found], pa.string())
            yield pa.StructArray.from_arrays([_lists(found), back], ["ids", "decoded"])

    return both(text)


def encode_documents(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """Add ids, n_ids and decoded to every row.

    Null text counts as empty: no ids and an empty decoded text. Rows are kept one for one, repeated
    rows too; an empty table gives an empty result; columns of these names are replaced, others stay."""
    out = beside(df, _code(F.coalesce(F.col(text_col), F.lit("")), model_path))
    n_ids = F.size("new.ids").cast("long").alias("n_ids")
    return out.select(*kept(df, "ids", "n_ids", "decoded"), "new.ids", n_ids, "new.decoded")
