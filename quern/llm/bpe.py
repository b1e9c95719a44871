"""Byte-level BPE encoding and decoding by corpus-level merge replay."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked, small_batches, table, text_slices

#: Bytes of text, and different units, whose words are replayed together by a task; what comes after is the next lot.
LOT, UNITS = 32 << 20, 500_000
NONE = 1 << 30


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    """Ranks of a .tiktoken file; by default the installed 50k byte-level vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class MergeReplay:
    """Encodes the words of many texts at once: every merge is replayed, in rank order, at all of its places.

    The different words stand one after another, parted by a gap. An inverted index leads from each
    pair (by the rank of the token that it makes) to its positions in all words. Ranks are taken
    from the lowest; a rank's positions come from the index, are merged together, and only the
    pairs with the two neighbours of each change: their new positions are entered under their own
    ranks, and what was entered for a pair that is gone is passed over when its rank comes.

    A new pair may have a rank below the one at hand, where a vocabulary has a token before the
    tokens that it is made of here. A word with such a pair is replayed on its own, merge by merge,
    so the ids are always those of the lowest rank, leftmost first.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: b for b, i in ranks.items()}
        self.numerals = {i: str(i) for i in self.tokens}
        # each pair that makes a token, whatever the split: at most one for each inner place of a token
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 24 | b] = rank
        self.pairs = pairs
        self.codes = np.array(sorted(pairs), np.int64)
        self.code_ranks = np.array([pairs[c] for c in self.codes.tolist()], np.int32)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        # a match of the usual pattern never goes on from a text's solid part into white space: units are split there first
        blank = "".join(c for c in map(chr, range(0x3001)) if regex.fullmatch(r"\s", c))
        self.blank = frozenset(blank)
        self.units = re.compile(f"[{blank}]*[^{blank}]+|[{blank}]+") if pattern == default_pattern() else None
        self.crowded = re.compile(f" [{blank}]|[{blank}] ").search

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair makes; NONE where it makes none, or where one side is a gap."""
        if not len(self.codes):
            return np.full(len(left), NONE, np.int32)
        code = left.astype(np.int64) << 24 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (left >= 0) & (right >= 0), self.code_ranks[at], NONE).astype(np.int32)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word: (ids of all, where each word's begin, and the end)."""
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        total = int(starts[-1]) + 1
        token = np.full(total, -1, np.int32)
        inner = np.ones(total, bool)
        inner[starts] = False
        token[inner] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        if (token[inner] < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        after, before = np.arange(1, total + 1, dtype=np.int32), np.arange(-1, total - 1, dtype=np.int32)
        after[-1] = total - 1
        before[0] = 0
        # the index: entry is the rank of the pair that a position begins; places[rank] are lists of positions
        entry = np.full(total, NONE, np.int32)
        entry[:-1] = self._ranks(token[:-1], token[1:])
        first = np.flatnonzero(entry < NONE)
        by_rank = first[np.argsort(entry[first], kind="stable")].astype(np.int32)
        places: dict[int, list[np.ndarray]] = {}
        self._enter(places, by_rank, entry[by_rank])
        odd: list[np.ndarray] = []
        top = int(self.code_ranks.max()) + 1 if len(self.code_ranks) else 0
        for rank in range(top):
            lists = places.pop(rank, None)
            if lists is None:
                continue
            at = np.concatenate(lists)
            at = np.unique(at[entry[at] == rank])
            if not len(at):
                continue
            # pairs of one rank that overlap, as in a run of one letter: the leftmost, then every other
            overlaps = after[at[:-1]] == at[1:]
            if overlaps.any():
                begins = np.flatnonzero(np.append(True, ~overlaps))
                at = at[(np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))) % 2 == 0]
            gone = after[at]
            token[at], entry[gone], token[gone] = rank, NONE, -2
            beyond = after[gone]
            after[at] = beyond
            before[beyond] = at
            left = before[at]
            changed = np.concatenate([left, at])
            new = self._ranks(token[changed], token[after[changed]])
            entry[changed] = new
            if (new < rank).any():
                odd.append(changed[new < rank])
            keep = new < NONE
            changed, new = changed[keep], new[keep]
            order = np.argsort(new, kind="stable")
            self._enter(places, changed[order], new[order])
        alive = np.flatnonzero(token >= 0)
        ends = np.searchsorted(alive, starts)
        ids = token[alive]
        if odd:
            ids, ends = self._again(words, ids, ends, set((np.searchsorted(starts, np.concatenate(odd), "right") - 1).tolist()))
        return ids, ends

    @staticmethod
    def _enter(places: dict[int, list[np.ndarray]], at: np.ndarray, ranks: np.ndarray) -> None:
        """Enter positions, which come sorted by rank, under their ranks."""
        if not len(at):
            return
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        begins = [0, *cuts.tolist(), len(at)]
        for r, a, b in zip(ranks[begins[:-1]].tolist(), begins, begins[1:]):  # noqa: B905
            held = places.get(r)
            if held is None:
                places[r] = [at[a:b]]
            else:
                held.append(at[a:b])

    def _again(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray, odd: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """The same, with the odd words' ids taken merge by merge."""
        parts = [ids[a:b] if i not in odd else np.array(self.merge(words[i]), np.int32) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of the lowest rank, leftmost first, again and again."""
        x = [int(self.single[b]) for b in word]
        while len(x) > 1:
            rank, i = min((self.pairs.get(a << 24 | b, NONE), i) for i, (a, b) in enumerate(zip(x, x[1:])))  # noqa: B905
            if rank == NONE:
                break
            x[i : i + 2] = [rank]
        return x

    def encode(self, texts: Iterable[str]) -> list[list[int]]:
        """Ids of each text; the texts' different words are replayed together."""
        lot = Lot(self)
        for t in texts:
            lot.add(t)
        lot.close()
        return [lot.ids(k).tolist() for k in range(len(lot.texts))]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Lot:
    """Texts as lists of units, each different unit once; close() replays the words of all units together."""

    def __init__(self, coder: MergeReplay):
        self.coder, self.texts, self.size = coder, [], 0
        number = count().__next__
        # units by what they are, and units that are a blank and what they are here
        self.plain: defaultdict[str, int] = defaultdict(number)
        self.spaced: defaultdict[str, int] = defaultdict(number)

    def add(self, text: str) -> None:
        coder = self.coder
        if coder.units and not coder.crowded(text):
            # each blank stands alone between solid parts: a unit begins at each
            first, *rest = text.split(" ")
            codes = np.fromiter(map(self.spaced.__getitem__, rest), np.int32, len(rest))
            if first:
                codes = np.concatenate([np.array([self.plain[first]], np.int32), codes])
        else:
            split = (coder.units or coder.pattern).findall(text)
            codes = np.fromiter(map(self.plain.__getitem__, split), np.int32, len(split))
        self.texts.append(codes)
        self.size += len(text)

    def full(self) -> bool:
        return self.size >= LOT or len(self.plain) + len(self.spaced) >= UNITS

    def close(self) -> None:
        """Units are split by the pattern into words, words replayed; a unit's ids are its words' in order."""
        coder, split = self.coder, self.coder.pattern.findall
        units = [""] * (len(self.plain) + len(self.spaced))
        for u, i in self.plain.items():
            units[i] = u
        for u, i in self.spaced.items():
            units[i] = f" {u}"
        lengths, words = np.ones(len(units), np.int64), units
        if coder.units:
            # units from a blank to a solid end stay apart when they stand in a row, and are split as one text
            row = [i for i, u in enumerate(units) if u[0] in coder.blank and u[-1] not in coder.blank]
            rest = sorted(set(range(len(units))) - set(row))
            joined = split("".join([units[i] for i in row]))
            ends = np.searchsorted(np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined))), np.cumsum([len(units[i]) for i in row])) + 1
            apart = [split(units[i]) for i in rest]
            lengths[row] = np.diff(np.concatenate([[0], ends]))
            lengths[rest] = [len(x) for x in apart]
            words = joined + list(chain.from_iterable(apart))
            first = np.zeros(len(units), np.int64)
            first[row + rest] = np.cumsum(lengths[row + rest]) - lengths[row + rest]
        place: defaultdict[str, int] = defaultdict(count().__next__)
        parts = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        if coder.units:
            parts = parts[_ranges(first, lengths)]
        ids, ends = coder.replay([w.encode() for w in place])
        sizes = np.diff(ends)[parts]
        self._ids = ids[_ranges(ends[:-1][parts], sizes)]
        self._ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)[np.concatenate([[0], np.cumsum(lengths)])]
        self.plain.clear()
        self.spaced.clear()

    def ids(self, k: int) -> np.ndarray:
        codes = self.texts[k]
        starts = self._ends[codes]
        return self._ids[_ranges(starts, self._ends[codes + 1] - starts)]

    def digests(self) -> Iterator[tuple[int, str, str]]:
        """Of each text: the number of its ids, the digest of the ids, and that of the bytes that they decode to."""
        numerals, tokens, ids = self.coder.numerals, self.coder.tokens, self._ids.tolist()
        said, decoded = (self._pieces(f, ids, sep) for f, sep in ((numerals, " "), (tokens, b"")))
        sizes = np.diff(self._ends)
        for codes in self.texts:
            of = codes.tolist()
            yield int(sizes[codes].sum()), hashlib.sha256(" ".join(map(said.__getitem__, of)).encode()).hexdigest(), hashlib.sha256(b"".join(map(decoded.__getitem__, of))).hexdigest()

    def _pieces(self, f: dict, ids: list[int], sep) -> list:
        """Each unit's ids written by f, joined by sep: cut from the whole."""
        parts = list(map(f.__getitem__, ids))
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + len(sep))])
        whole, ends = sep.join(parts), at[self._ends].tolist()
        return [whole[a : b - len(sep)] for a, b in zip(ends, ends[1:])]  # noqa: B905


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 .. for sizes[0] values, and so on."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    ahead = np.cumsum(sizes) - sizes
    return np.repeat(starts - ahead, sizes) + np.arange(int(sizes.sum()))


def _coder(spark: SparkSession, ranks: dict[bytes, int] | None, pattern: str | None):
    """The coder, broadcast: its size is the vocabulary's."""
    shared = spark.sparkContext.broadcast(MergeReplay(ranks or load_ranks(), pattern or default_pattern()))
    return lambda: shared.value


def _with(docs: DataFrame, column: str, added: str, names: list[str], start: Callable, lots: bool) -> DataFrame:
    """docs with columns made of `column`, by batches, or by lots of texts that are coded together."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in names]
    source = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{column}`").alias("__in"))
    labels = [*[f"c{i}" for i in range(len(keep))], *names]

    def out(rows: pa.RecordBatch, arrays: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], *arrays], names=labels)

    def by_batch(batches):
        work = start()
        for batch in batches:
            yield out(batch, work(batch))

    def by_lot(batches):
        coder, result = start()
        lot, held = Lot(coder), []

        def flush():
            lot.close()
            made, k = result(lot), 0
            for rows in held:
                yield out(rows, made(k, rows.num_rows))
                k += rows.num_rows

        for batch in batches:
            for at, texts in text_slices(batch, "__in"):
                held.append(batch.slice(at, len(texts)).select(labels[: len(keep)]))
                for x in texts:
                    lot.add(x.decode())
                if lot.full():
                    yield from flush()
                    lot, held = Lot(coder), []
        if held:
            yield from flush()

    fields = "".join(f"c{i} {source.schema[f'c{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    made = source.mapInArrow(by_lot if lots else by_batch, fields + added)
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *names)


def encode_texts(docs: DataFrame, text: str = "text", ranks: dict[bytes, int] | None = None, pattern: str | None = None) -> DataFrame:
    """All columns, and ids array<int>: the whole text's byte-level BPE ids, without special tokens.

    Each match of `pattern` is encoded on its own. The corpus whose different words an index covers
    is a lot: LOT bytes of the texts of a task, or the first that have UNITS different units. Null and
    empty texts have no ids. Tokens are at most 2^24. A column ids of the input is replaced; rows keep
    their number, repeated rows too.
    """
    checked(docs, text)
    coder = _coder(docs.sparkSession, ranks, pattern)

    def start():
        def result(lot):
            def made(k, n):
                ids = [lot.ids(i) for i in range(k, k + n)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                return [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)))]

            return made

        return coder(), result

    return _with(docs, text, "ids array<int>", ["ids"], start, True)


def decode_ids(rows: DataFrame, ids: str = "ids", ranks: dict[bytes, int] | None = None) -> DataFrame:
    """All columns, and decoded binary: the ids' bytes (null: empty). A null or unknown id is an error."""
    checked(rows, ids)
    coder = _coder(rows.sparkSession, ranks, None)

    def start():
        code = coder()
        return lambda batch: [pa.array([code.decode(x or ()) for x in batch.column("__in").to_pylist()], pa.binary())]

    return _with(rows, ids, "decoded binary", ["decoded"], start, False)


def round_trip(docs: DataFrame, text: str = "text", ranks: dict[bytes, int] | None = None, pattern: str | None = None) -> DataFrame:
    """All columns, and n_tokens long, ids_sha256, decoded_sha256: digests of what encode_texts and decode_ids give.

    The digests are made where the ids are, so ids need not leave the task; each different unit is
    written out and decoded once a lot. Null and empty texts have 0 tokens and the digests of nothing.
    """
    checked(docs, text)
    coder = _coder(docs.sparkSession, ranks, pattern)

    def start():
        def result(lot):
            digests = lot.digests()

            def made(k, n):
                rows = [next(digests) for _ in range(n)]
                return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]

            return made

        return coder(), result

    return _with(docs, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["n_tokens", "ids_sha256", "decoded_sha256"], start, True)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
