"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of whole labelled texts. A text is parsed into
phrases, each the longest match with that sample from where the last one ended; the language that
needs the fewest phrases, normalised by the bits that naming a place in its sample takes, wins.

Symbols are the UTF-8 bytes of lower-cased letters, all of them, with one space between words. So every
script is told apart and a table has 256 columns at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, kept

#: Labelled rows looked at per language, and the bytes of whole rows that its sample may take. The rows
#: left over (CHECK_BYTES of them at most) calibrate the score.
SAMPLE_ROWS, SAMPLE_BYTES, CHECK_BYTES = 128, 96_000, 96_000
#: Learned languages at most: a table of about 3 MB each goes to every worker.
MAX_LANGUAGES = 500
#: Symbols of a block and blocks that are parsed side by side; neither changes a result.
BLOCK, LANES = 512, 2048
UNKNOWN = "und"
#: Score of a text as cheap as the calibration rows; one as dear as the same letters shuffled has 1 - this.
USUAL = 0.99
_NO_LETTERS = re.compile(r"[\W\d_]+")


class SuffixAutomaton:
    """The least automaton of all substrings of a sequence of symbols (Blumer et al. 1985)."""

    def __init__(self, symbols: bytes):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for c in symbols:
            new = self._state({}, self.length[last] + 1)
            at = last
            while at >= 0 and c not in self.next[at]:
                self.next[at][c] = new
                at = self.link[at]
            if at >= 0:
                to = self.next[at][c]
                if self.length[to] == self.length[at] + 1:
                    self.link[new] = to
                else:
                    split = self._state(dict(self.next[to]), self.length[at] + 1)
                    self.link[split], self.link[to], self.link[new] = self.link[to], split, split
                    while at >= 0 and self.next[at].get(c) == to:
                        self.next[at][c] = split
                        at = self.link[at]
            else:
                self.link[new] = 0
            last = new

    def _state(self, follow: dict[int, int], length: int) -> int:
        self.next.append(follow)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1


def symbols(text: str) -> bytes:
    """Letters in lower case with one space for whatever is between them, led by a space."""
    return (" " + _NO_LETTERS.sub(" ", text.lower()).strip(" ")).encode("utf-8", "surrogatepass")


def phrases(automaton: SuffixAutomaton, text: bytes) -> int:
    """Longest-match phrases of a text; a symbol outside the sample is a phrase alone."""
    count = state = 0
    for c in text:
        follow = automaton.next[state].get(c) if state else None
        if follow is None:
            count += 1
            follow = automaton.next[0].get(c, 0)
        state = follow
    return count


def _displaced(states: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The transitions of all states but the first, laid over each other in one row.

    A state is named by where its transitions begin (no two begin at one place): entry state + symbol
    holds state << 32 | next state if that transition exists. Returns the row and each state's name."""
    taken, names, used = bytearray(1 << 12), [0] * len(states), set()
    order = sorted(range(1, len(states)), key=lambda s: (-len(states[s]), s))
    first, width = 256, -1
    for s in order:
        keys = sorted(states[s]) or [0]
        if len(keys) != width:
            width, first = len(keys), 256
        at, tries = first, 0
        while True:
            at = taken.find(0, at)
            if at < 0 or at + 512 > len(taken):
                taken.extend(bytes(len(taken)))
                at = max(first, 0) if at < 0 else at
                continue
            base = at - keys[0]
            if base not in used and not any(taken[base + c] for c in keys):
                break
            at += 1
            tries += 1
            if tries > 64:
                first = at
        if width == 1 and not tries:
            first = at
        used.add(base)
        names[s] = base
        for c in states[s]:
            taken[base + c] = 1
    return names, max(used, default=256) + 512


@dataclass
class CrossParser:
    """Phrase counts of many texts for all languages at once, by table look-ups in lock step."""

    languages: list[str]
    bits: np.ndarray  # that naming a phrase takes
    table: np.ndarray
    roots: np.ndarray  # a state of each language that has no transition here
    firsts: np.ndarray  # by language and symbol: the state after a phrase's first symbol
    middle: np.ndarray  # bits a symbol at which the score is halved
    slope: np.ndarray

    @classmethod
    def fit(cls, samples: dict[str, list[bytes]], checks: dict[str, list[bytes]] | None = None) -> CrossParser:
        """Automata of the sample texts; the score is calibrated on the check texts of each language."""
        if len(samples) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        languages, bits, tables, roots, firsts, base = sorted(samples), [], [], [], [], 0
        for name in languages:
            text = b"".join(samples[name])
            states = SuffixAutomaton(text).next
            names, size = _displaced(states)
            root = size - 256
            names[0] = root
            table = np.full(size, -1, np.int64)
            for s, follow in enumerate(states[1:], 1):
                for c, to in follow.items():
                    table[names[s] + c] = (names[s] + base) << 32 | (names[to] + base)
            tables.append(table)
            roots.append(root + base)
            firsts.append([names[states[0][c]] + base if c in states[0] else root + base for c in range(256)])
            bits.append(log2(max(len(text), 2)))
            base += size
        n = len(languages)
        parser = cls(languages, np.array(bits), np.concatenate(tables) if n else np.zeros(0, np.int64), np.array(roots, np.int64), np.array(firsts, np.int64).reshape(n, 256), np.full(n, np.inf), np.ones(n))
        for i, name in enumerate(languages):
            parser._calibrate(i, (checks or {}).get(name) or [])
        return parser

    def _calibrate(self, i: int, texts: list[bytes]) -> None:
        """The cost at which a text is as far from the language as from the same letters in any order."""
        texts = [t for t in texts if len(t) >= 200] or [t for t in texts if len(t) > 1]
        if not texts:
            return
        rng = np.random.default_rng(11)
        mixed = []
        for t in texts:
            letters = list(t.decode("utf-8", "surrogatepass"))
            mixed.append("".join(letters[k] for k in rng.permutation(len(letters))).encode("utf-8", "surrogatepass"))
        own, other = (np.median(self.costs(self.counts(x), x)[:, i]) for x in (texts, mixed))
        if 0 < own < other:
            self.middle[i] = float(np.sqrt(own * other))
            self.slope[i] = log(USUAL / (1 - USUAL)) / log(self.middle[i] / own)

    def costs(self, counts: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Bits a symbol; the last phrase is cut off by the text's end and left out."""
        return (counts - 1) * self.bits / np.array([max(len(t), 1) for t in texts])[:, None]

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Phrases per text (rows) and language (columns).

        Texts are cut into blocks that are parsed side by side from their starts, then mended: the
        phrase that is open at a block's end is carried on until both parses start a phrase at one
        symbol, from where on they agree. So phrases run over block ends as in phrases()."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        lengths = np.array([len(t) for t in texts])
        blocks = -(-lengths // BLOCK)
        whole = b"".join(t + bytes(-len(t) % BLOCK) for t in texts)
        every = np.frombuffer(whole, np.uint8).reshape(-1, BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        sizes = np.minimum(lengths[owner] - at * BLOCK, BLOCK)
        carried = np.zeros((len(self.languages), 0), np.int64)
        for a in range(0, len(every), LANES):
            b = min(a + LANES, len(every))
            carried = self._parse(every[a:b], sizes[a:b], owner[a:b], at[a:b], carried, out)
        return out

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase started; rows are languages."""
        entry = self.table[state + symbol]
        on = (entry >> 32) == state
        return np.where(on, entry & 0xFFFFFFFF, self.firsts[:, symbol]), ~on

    def _parse(self, blocks, sizes, owner, at, carried, out) -> np.ndarray:
        """Counts of consecutive blocks; carried: the states before the first one. Returns those after the last."""
        n, languages = len(blocks), len(self.languages)
        order = np.argsort(-sizes, kind="stable")
        columns = np.ascontiguousarray(blocks[order].T)
        live = np.searchsorted(-sizes[order], -np.arange(BLOCK), "left")
        state = np.repeat(self.roots[:, None], n, axis=1)
        started = np.zeros((BLOCK, languages, n), bool)
        for k in range(BLOCK):
            m = live[k]
            if not m:
                break
            state[:, :m], started[k, :, :m] = self._step(state[:, :m], columns[k, :m].astype(np.int64))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        started, final = started[:, :, place], state[:, place]  # in the order of the blocks again
        total = started.sum(axis=0, dtype=np.int64)
        # mend: (language, block) pairs and the true state before them
        first = carried.shape[1] > 0 and at[0] > 0
        follows = np.flatnonzero(at[1:] > 0) + 1 if n > 1 else np.zeros(0, np.int64)
        todo = {}
        lang, block = (x.ravel() for x in np.meshgrid(np.arange(languages), follows, indexing="ij"))
        true = final[lang, block - 1] if len(block) else np.zeros(0, np.int64)
        if first:
            lang, block = np.concatenate((np.arange(languages), lang)), np.concatenate((np.zeros(languages, np.int64), block))
            true = np.concatenate((carried[:, 0], true))
        change = np.zeros((languages, n), np.int64)
        while len(block):
            more, ends = self._mend(blocks, sizes, started, lang, block, true)
            change[lang, block] = more
            # a block whose end is another than was taken for the next one: that one is done again
            new = ends >= 0
            moved = new & (ends != final[lang, block])
            final[lang[new], block[new]] = ends[new]
            again = moved & (block + 1 < n)
            again[again] = at[block[again] + 1] > 0
            lang, block, true = lang[again], block[again] + 1, ends[again]
        np.add.at(out, owner, (total + change).T)
        return final[:, -1:]

    def _mend(self, blocks, sizes, started, lang, block, state) -> tuple[np.ndarray, np.ndarray]:
        """Per pair: phrase starts more than counted, and the state at the block's end (-1: as counted)."""
        more, ends = np.zeros(len(block), np.int64), np.full(len(block), -1, np.int64)
        live = np.arange(len(block))
        k = 0
        while len(live):
            over = sizes[block[live]] <= k
            if over.any():
                ends[live[over]] = state[over]
                live, state = live[~over], state[~over]
                if not len(live):
                    break
            symbol, rows = blocks[block[live], k].astype(np.int64), lang[live]
            entry = self.table[state + symbol]
            on = (entry >> 32) == state
            was = started[k, rows, block[live]]
            go = on | ~was  # both start a phrase here: from here on they agree
            more[live] += (~on).astype(np.int64) - was
            state = np.where(on, entry & 0xFFFFFFFF, self.firsts[rows, symbol])[go]
            live = live[go]
            k += 1
        return more, ends

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if known and self.languages:
            found = [symbols(texts[i]) for i in known]
            counts = self.counts(found)
            bits = counts * self.bits
            best = bits.argmin(axis=1)
            share = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 60)).sum(axis=1)
            cost = self.costs(counts, found)[np.arange(len(known)), best]
            fit = 1 / (1 + np.exp(np.minimum(self.slope[best] * (np.log(np.maximum(cost, 1e-9)) - np.log(self.middle[best])), 700)))
            for i, b, s in zip(known, best, share * fit, strict=True):
                out[i] = self.languages[b], float(s)
        return out


def learn(df: DataFrame, where: Column, text: str = "text", lang: str = "lang") -> CrossParser:
    """A parser fitted on the rows where `where` holds and text and lang are known.

    A language's texts are dealt to SAMPLE_ROWS cells by hash and the least hash of each cell is taken,
    so the choice is one aggregation without texts and a copy counts once. Whole texts are then taken by
    hash: every other one into the sample while it stays within SAMPLE_BYTES, the rest for calibration
    within CHECK_BYTES; a text that does not fit is passed over, never cut (the shortest is taken if none
    fits). Only these are collected. The choice does not depend on order, partitions or any key."""
    rows = df.where(where & F.col(text).isNotNull() & F.col(lang).isNotNull() & F.rlike(text, F.lit(r"\p{L}"))).select(F.xxhash64(text).alias("h"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    least = rows.groupBy("lang", F.pmod("h", F.lit(SAMPLE_ROWS)).alias("cell")).agg(F.min(F.struct("h", F.octet_length("text").alias("n"))).alias("x"))
    found: dict[str, list[tuple[int, int]]] = {}
    for row in least.select("lang", "x.*").collect():
        found.setdefault(row["lang"], []).append((row["h"], row["n"]))
    use: dict[tuple[str, int], bool] = {}
    for name, choice in found.items():
        left = {True: SAMPLE_BYTES, False: CHECK_BYTES}
        turn = True
        for h, n in sorted(choice):
            if n <= left[turn]:
                use[name, h] = turn
                left[turn] -= n
                turn = not turn
        if left[True] == SAMPLE_BYTES:
            use[name, min(choice, key=lambda x: (x[1], x[0]))[0]] = True
    if not use:
        return CrossParser.fit({})
    spark = df.sparkSession
    wanted = spark.createDataFrame([(*k, v) for k, v in use.items()], "lang string, h long, sample boolean")
    got = rows.join(F.broadcast(wanted), ["lang", "h"]).groupBy("lang", "h", "sample").agg(F.min("text").alias("text")).collect()
    samples: dict[bool, dict[str, list[bytes]]] = {True: {}, False: {}}
    for row in sorted(got, key=lambda r: (r["lang"], r["h"])):
        samples[row["sample"]].setdefault(row["lang"], []).append(symbols(row["text"]))
    return CrossParser.fit(samples[True], samples[False])


def identify(df: DataFrame, parser: CrossParser, text: str = "text") -> DataFrame:
    """Add lang_pred and score (0 to 1) to every row, from the text alone.

    `und` with score 0 for null text, text without a letter, or no learned language. Ties go to the
    first language by name. score is the winner's share among 2^-bits of all languages, times how
    likely its bits a symbol are for the language: about 0.99 for usual ones, a half midway to those of
    shuffled letters, near 0 for a script that no sample has. Texts are parsed whole.
    Repeated rows get one answer each; an empty table gives an empty result; columns of these names are
    replaced, others stay."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found: list[tuple[str, float]] = []
            texts, size = [], 0
            for t in batch:
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size > 1_000_000:
                    found += parser.predict(texts)
                    texts, size = [], 0
            found += parser.predict(texts)
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang_pred", "score"])

    return beside(df, predict(F.col(text))).select(*kept(df, "lang_pred", "score"), "new.lang_pred", "new.score")
