"""Suffix-array dedup of repeated byte strings over sampled suffixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checked, row_keys, table, text_slices

#: Bytes that a repeated string has at least, and the bytes whose hash orders positions (a gram).
LENGTH, GRAM = 400, 16
#: Suffixes of a bucket: one ends at the next boundary after BUCKET; HOT bounds those that share a key.
BUCKET, HOT = 6_000, 20_000
#: Suffixes of a range partition, which holds many buckets, and bytes of a text whose grams are hashed at once.
RANGE, CHUNK = 100_000, 1 << 18
#: Parts that the rows of one key are dealt to; at most 64, the bits of a mask.
SLOTS = 64


class Shape:
    """How far a repeated string of `length` bytes reaches to both sides of the anchor in its middle.

    The anchor is the least gram of the middle half, [length/4, 3*length/4), so it has near..far
    bytes before it, and both occurrences of the string have it at the same place.
    """

    def __init__(self, length: int):
        if length < 4 * GRAM:
            raise ValueError(f"length must be {4 * GRAM} or more")
        self.length, self.near = length, length // 4
        self.far = 3 * length // 4 - GRAM
        self.window = self.far - self.near + 1
        self.right = length - self.near
        #: Bytes after an anchor that every string with it has: the leading bytes of its suffix.
        self.lead = length - self.far


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each window of w values, by doubling."""
    n = 1
    while 2 * n <= w:
        x, n = f(x[:-n], x[n:]), 2 * n
    return f(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


def anchors(text: bytes, shape: Shape) -> np.ndarray:
    """Positions whose gram is the least of some window: content alone decides, in each window one or more.

    A long text is read in chunks that overlap by a window on both sides, all a position's windows
    being within its chunk, so memory does not grow with the text.
    """
    n, edge = len(text) - GRAM + 1, shape.window - 1
    if len(text) < shape.length:
        return np.zeros(0, np.int64)
    chosen = []
    for lo in range(0, n, CHUNK):
        hi, a, b = min(n, lo + CHUNK), max(0, lo - edge), min(n, lo + CHUNK + edge)
        at = np.flatnonzero(_least_in_window(text[a : b + GRAM - 1], shape.window)) + a
        chosen.append(at[(at >= lo) & (at < hi)])
    found = np.concatenate(chosen)
    return found[(found >= shape.near) & (found + shape.lead <= len(text))]


def _least_in_window(text: bytes, window: int) -> np.ndarray:
    """For each gram, whether its hash is the least of a whole window of grams in text."""
    n = len(text) - GRAM + 1
    if n < window:
        return np.zeros(n, bool)
    a, b = (np.ndarray((n,), "<u8", text, at, (1,)) for at in (0, 8))
    h = a * np.uint64(0x9E3779B97F4A7C15) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least = _slide(h, window, np.minimum)
    edge = np.zeros(window - 1, np.uint64)
    return _slide(np.concatenate([edge, least, edge]), window, np.maximum) == h


def multikey_quicksort(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Order of byte strings, zero-padded in `rows` (uint8, a multiple of 8 wide); ties by length.

    Multikey quicksort over 8-byte tokens: a segment is split by a pivot token into lower, equal and
    higher; the equal part goes on with the next token. Short segments are sorted outright.
    """
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order, depth_end = np.arange(len(rows)), words.shape[1]
    todo = [(0, len(rows), 0)]
    while todo:
        lo, hi, d = todo.pop()
        if hi - lo < 2:
            continue
        seg = order[lo:hi]
        if d == depth_end:
            order[lo:hi] = seg[np.argsort(lengths[seg], kind="stable")]
            continue
        token = words[seg, d]
        if hi - lo <= 48:
            raw = rows[seg, 8 * d :]
            keys = [r.tobytes() for r in raw]
            order[lo:hi] = seg[sorted(range(len(seg)), key=lambda i: (keys[i], lengths[seg[i]]))]
            continue
        pivot = np.sort(token[[0, len(token) // 2, -1]])[1]
        low, high = token < pivot, token > pivot
        n_low, n_high = int(low.sum()), int(high.sum())
        order[lo:hi] = np.concatenate([seg[low], seg[~(low | high)], seg[high]])
        todo += [(lo, lo + n_low, d), (lo + n_low, hi - n_high, d + 1), (hi - n_high, hi, d)]
    return order


def common_prefixes(rows: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each string in order shares with the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for s in range(1, len(order), 8192):
        i, j = order[s : s + 8192], order[s - 1 : s - 1 + 8192][: len(order[s : s + 8192])]
        differ = rows[i] != rows[j]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[s : s + len(i)] = np.minimum(first, np.minimum(lengths[i], lengths[j]))
    return out


def _padded(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    width = -(-width // 8) * 8
    flat = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width)
    return flat, np.array([len(v) for v in values], np.int64)


def repeated_offsets(lefts: list[bytes], rights: list[bytes], shape: Shape, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor, the least and most bytes before it at which a repeated string starts; -1: none.

    low, high: the least and most bytes that each row is asked for; by default all.

    rights are the suffixes from the anchors, lefts the bytes before them, read backwards. Both are
    sorted; strings that share d bytes are a run of the sorted order whose common prefixes are d or
    more. A string with o bytes before its anchor is repeated where another anchor is in the same
    run of lefts at o and of rights at length - o.
    """
    n = len(rights)
    least, most = np.full(n, -1), np.full(n, -1)
    low = np.full(n, shape.near) if low is None else low
    high = np.full(n, shape.far) if high is None else high
    (r, rn), (f, fn) = _padded(rights, shape.right), _padded(lefts, shape.far)
    order_r, order_f = multikey_quicksort(r, rn), multikey_quicksort(f, fn)
    shared_r, shared_f = common_prefixes(r, rn, order_r), common_prefixes(f, fn, order_f)
    # the most that an anchor shares with any other is what it shares with a neighbour in the order
    most_r, most_f = np.empty(n, np.int64), np.empty(n, np.int64)
    most_r[order_r] = np.maximum(shared_r, np.append(shared_r[1:], 0))
    most_f[order_f] = np.maximum(shared_f, np.append(shared_f[1:], 0))
    run_r, run_f = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(shape.near, shape.far + 1):
        fits = np.flatnonzero((most_r >= shape.length - o) & (most_f >= o) & (low <= o) & (o <= high))
        if len(fits) < 2:
            continue
        run_r[order_r] = np.cumsum(shared_r < shape.length - o)
        run_f[order_f] = np.cumsum(shared_f < o)
        key = run_r[fits] * (n + 1) + run_f[fits]
        by = np.argsort(key, kind="stable")
        same = np.zeros(len(by), bool)
        equal = key[by][1:] == key[by][:-1]
        same[1:] |= equal
        same[:-1] |= equal
        hit = fits[by[same]]
        least[hit] = np.where(least[hit] < 0, o, least[hit])
        most[hit] = o
    return least, most


def _mask(slot: Column) -> Column:
    """The slots that a group's rows are in, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot)).alias("mask")


def _slots() -> Column:
    """A row for each slot of the mask."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.bit_get(F.col("mask"), k) == 1)).alias("slot")


def repeated_spans(docs: DataFrame, text: str = "text", id: str = "doc_id", length: int = LENGTH, as_text: bool = False, words: int = 0) -> DataFrame:
    """Bytes covered by a string of `length` bytes that starts anywhere else too: all columns, and n_bytes, spans, kept.

    spans: array of (start, stop), the maximal covered runs of the text's UTF-8 bytes, judged on the
    input, overlaps included; kept: the other bytes, as binary, or with as_text as a string, in which
    halves of a character that a cut leaves are dropped. With `words`, a run that holds fewer whole
    words (WORD) than that stays in the text and is no span.

    Suffixes are sampled by content: a position is an anchor where its 16-byte gram hashes least in
    some window of half of `length`, about one position in 90. Every string of `length` bytes has
    an anchor in its middle half, and so have its other occurrences, at the same place; nothing is
    missed. Then:
    1. An anchor whose surroundings of `length / 2` bytes occur once is alone: counted and dropped.
    2. Anchors with the same full surroundings are one class; a class of two or more is covered as
       far as these reach. Copies end here, however many there are.
    3. Other classes that share leading bytes with a different class are suffixes to sort: sampled
       splitters over the leading bytes, then step 1's hash, range-partition them; within a
       partition each bucket, cut where the key changes, is sorted by multikey quicksort, forwards
       from the anchor and backwards before it, and neighbours are compared. Keys are made of bytes
       that any match shares, so no match lies across a boundary. More than HOT classes of one key
       are split by deeper bytes: strings that start lo..hi bytes before the anchor share lo bytes
       before it and length - hi after it, so each half of the offsets has a longer key of its own,
       and so on; classes with the same bytes wherever a half's strings lie go on as one.
    4. The classes' reach goes back to all their anchors, and a document's spans are joined to it.

    Surroundings are compared by 64-bit (step 1, which may only keep too many) and 128-bit hashes.
    Null and empty texts have no bytes; texts shorter than `length` keep all. Matches never cross
    documents. Repeated rows are copies of each other. An empty table gives an empty result. Columns
    of the result's own names are replaced.
    """
    checked(docs, text, id)
    spark, scratch, shape = docs.sparkSession, Scratch(docs.sparkSession, "suffixes"), Shape(length)
    docs = docs.drop("n_bytes", "spans", "kept")
    t = F.col(f"`{text}`")
    # two rows with one key are the same row twice: both of its anchors are counted, and both get its spans
    keyed = docs.withColumns(dict(zip(("__k1", "__k2"), row_keys(F.col(f"`{id}`"), t), strict=True)))
    slim = keyed.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), t.cast("binary").alias("text"))

    def sample(batches):
        for batch in batches:
            for start, texts in text_slices(batch):
                rows, place, near, full = [], [], [], []
                for i, x in enumerate(texts, start):
                    at = anchors(x, shape).tolist()
                    rows += [i] * len(at)
                    place += at
                    near += [xxhash.xxh3_64_intdigest(x[p - shape.near : p + shape.lead]) for p in at]
                    full += [xxhash.xxh3_128_digest(x[max(0, p - shape.far) : p + shape.right], min(p, shape.far)) for p in at]
                both = np.frombuffer(b"".join(full), np.int64).reshape(-1, 2)
                part = batch.select(["k1", "k2"]).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(place, pa.int32()), pa.array(np.array(near, np.uint64).view(np.int64)), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["k1", "k2", "pos", "g", "c1", "c2"])

    sampled = scratch.save(slim.where(F.octet_length("text") >= length).mapInArrow(sample, "k1 long, k2 long, pos int, g long, c1 long, c2 long"), "anchors")
    # joins back to many rows of one key go by key and slot, so that no task holds a hot key's rows
    by_row, by_class = F.pmod("k1", F.lit(SLOTS)).cast("int"), F.pmod("c1", F.lit(SLOTS)).cast("int")
    twice = sampled.groupBy("g").agg(F.count(F.lit(1)).alias("__n"), _mask(by_row)).where("__n > 1").select("g", _slots())
    met = scratch.save(sampled.withColumn("slot", by_row).join(twice, ["g", "slot"]), "met")
    scratch.drop("anchors")
    classes = met.groupBy("g", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("at"), _mask(F.col("slot")))
    classes = scratch.save(classes, "classes")
    several = classes.groupBy("g").agg(F.count(F.lit(1)).alias("m"), _mask(by_class)).where("m > 1").select("g", "m", _slots())
    open_ = classes.drop("mask").withColumn("slot", by_class).join(several, ["g", "slot"]).select("g", "c1", "c2", "n", "m", "at.*").withColumn("slot", by_row)
    wanted = open_.groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "g", "c1", "c2", "slot", "n", "m")).alias("of"))
    names = ("g", "c1", "c2", "slot", "n", "m")

    def surroundings(batches):
        kinds = [*[pa.field(c, pa.int32() if c == "slot" else pa.int64()) for c in names], pa.field("before", pa.binary()), pa.field("after", pa.binary())]
        for batch in batches:
            for start, texts in text_slices(batch):
                out = {f.name: [] for f in kinds}
                for x, of in zip(texts, batch.column("of").slice(start, len(texts)).to_pylist(), strict=True):
                    for a in of:
                        for c in names:
                            out[c].append(a[c])
                        p = a["pos"]
                        out["before"].append(x[max(0, p - shape.far) : p][::-1])
                        out["after"].append(x[p : p + shape.right])
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kinds], schema=pa.schema(kinds))

    # repeated rows have one key, and one of them is enough
    around = slim.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("text", "of").mapInArrow(surroundings, "g long, c1 long, c2 long, slot int, n long, m long, before binary, after binary")
    around = scratch.save(around.withColumns({"lo": F.lit(shape.near), "hi": F.lit(shape.far), "key": F.col("g")}), "around")
    sortable, hits = _split(around, scratch, shape)

    def bucket(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows)
        least, most = repeated_offsets(t["before"].to_pylist(), t["after"].to_pylist(), shape, t["lo"].to_numpy(), t["hi"].to_numpy())
        hit = np.flatnonzero((most >= 0) & (t["n"].to_numpy() == 1))
        t = t.take(pa.array(hit)).select(["g", "c1", "c2", "slot"])
        t = t.append_column("back", pa.array(most[hit].astype(np.int32))).append_column("on", pa.array((shape.length - least[hit]).astype(np.int32)))
        return t.to_batches()

    def buckets(batches):
        """A partition's rows come sorted by key: buckets of BUCKET rows and what is left of the last key."""
        held, n, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, lo = batch.column("key").to_numpy(), batch.column("lo").to_numpy()
            change = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1])
            ends = [*([0] if last != (key[0], lo[0]) else []), *(np.flatnonzero(change) + 1).tolist()]
            start = 0
            for e in ends:
                if n + e - start >= BUCKET:
                    held.append(batch.slice(start, e - start))
                    yield from bucket(held)
                    held, n, start = [], 0, e
            held.append(batch.slice(start))
            n, last = n + batch.num_rows - start, (key[-1], lo[-1])
        if n:
            yield from bucket(held)

    # the union's rows of one class have ranges of offsets that do not overlap, so they never meet
    order = (F.substring("after", 1, GRAM), F.col("lo"), F.col("key"))
    ranged = sortable.repartitionByRange(max(1, -(-sortable.count() // RANGE)), *order).sortWithinPartitions(*order)
    reach = ranged.select("g", "c1", "c2", "slot", "n", "before", "after", "lo", "hi", "key").mapInArrow(buckets, "g long, c1 long, c2 long, slot int, back int, on int")
    if hits is not None:
        reach = reach.unionByName(hits)
        reach = reach.groupBy("g", "c1", "c2", "slot").agg(F.max("back").alias("back"), F.max("on").alias("on"))
    whole = classes.where("n > 1").select("g", "c1", "c2", _slots(), F.lit(shape.far).alias("back"), F.lit(shape.right).alias("on"))
    reach = whole.unionByName(reach)
    spans = met.join(reach, ["g", "c1", "c2", "slot"]).select("k1", "k2", F.greatest(F.lit(0), F.col("pos") - F.col("back")).alias("start"), (F.col("pos") + F.col("on")).alias("stop"))
    spans = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("__spans"))
    spans = scratch.save(spans, "spans")
    scratch.drop("met", "classes", "around")
    return _cut(keyed.join(spans, (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2")), "left"), docs.columns, text, as_text, words)


def _split(around: DataFrame, scratch: Scratch, shape: Shape) -> tuple[DataFrame, DataFrame | None]:
    """Rows (lo, hi, key) of at most HOT a key, to be sorted; and the classes (.., back, on) that were found while hot keys were split.

    Each round halves the offsets of the keys that are still hot. Strings of a half share lo bytes
    before the anchor and length - hi after it, the half's key; all of them lie within hi bytes
    before it and length - lo after it. Classes that agree on the latter have the same strings at
    all offsets of the half: they are found, and one of them goes on for all. At one offset both are
    the same bytes, so the rounds end there. A class whose bytes differ from others' in one place
    goes on where that place is between the two, which on average is less than one half a round.
    """
    sortable, found = around.where(F.col("m") <= HOT), None
    hot, k = around.where(F.col("m") > HOT), 0
    while not hot.isEmpty():
        k += 1
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct("lo", middle.alias("hi")), F.struct((middle + 1).alias("lo"), "hi"))).alias("part")
        parts = hot.drop("m", "key").withColumn("part", halves).withColumns({"lo": F.col("part.lo"), "hi": F.col("part.hi")}).drop("part")
        rest = lambda o: F.lit(shape.length) - F.col(o)
        parts = parts.where((F.col("lo") <= F.col("hi")) & (F.octet_length("before") >= F.col("lo")) & (F.octet_length("after") >= rest("hi")))
        inner = (F.col("lo"), F.substring("before", F.lit(1), F.col("lo")), F.substring("after", F.lit(1), rest("hi")))
        outer = (F.col("lo"), F.substring("before", F.lit(1), F.col("hi")), F.substring("after", F.lit(1), rest("lo")))
        parts = scratch.save(parts.withColumns({"key": F.xxhash64(*inner), "o1": F.xxhash64(*outer), "o2": F.xxhash64(F.lit(2), *outer)}), f"parts-{k}")
        same = ["lo", "hi", "key", "o1", "o2"]
        one = F.min(F.struct("g", "c1", "c2", "slot", "n", "before", "after")).alias("one")
        alike = scratch.save(parts.groupBy(*same).agg(F.count(F.lit(1)).alias("alike"), _mask(F.col("slot")), one), f"alike-{k}")
        several = alike.where("alike > 1").select(*same, _slots())
        reach = (F.least("hi", F.octet_length("before")).alias("back"), F.least(rest("lo"), F.octet_length("after")).alias("on"))
        hits = parts.where("n = 1").join(several, [*same, "slot"]).select("g", "c1", "c2", "slot", *reach)
        found = hits if found is None else found.unionByName(hits)
        left = alike.select("lo", "hi", "key", "one.*", "alike").withColumn("n", F.when(F.col("alike") > 1, F.lit(2).cast("long")).otherwise(F.col("n"))).drop("alike")
        sizes = left.groupBy("lo", "key").agg(F.count(F.lit(1)).alias("m"), _mask(F.col("slot"))).where("m > 1").select("lo", "key", "m", _slots())
        left = scratch.save(left.join(sizes, ["lo", "key", "slot"]), f"around-{k}")
        sortable = sortable.unionByName(left.where(F.col("m") <= HOT))
        hot = left.where(F.col("m") > HOT)
    return sortable, found


def _whole_words(x: bytes, start: int, stop: int) -> int:
    """Words that lie in x[start:stop] with both ends."""
    part = x[start:stop]
    inside = lambda i: 0 < i < len(x) and not x[i - 1 : i].isspace() and not x[i : i + 1].isspace()
    return len(part.split()) - inside(start) - inside(stop)


def _cut(joined: DataFrame, columns: list[str], text: str, as_text: bool, words: int = 0) -> DataFrame:
    """Merge each row's spans and cut them out."""
    keep = [c for c in columns if c != text]
    source = joined.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("binary").alias("text"), "__spans")
    was_text = joined.schema[text].dataType.simpleString()

    def run(batches):
        span = pa.list_(pa.struct([pa.field("start", pa.int32()), pa.field("stop", pa.int32())]))
        for batch in batches:
            for start, texts in text_slices(batch):
                part = batch.slice(start, len(texts))
                kept, merged = [], []
                for x, raw in zip(texts, part.column("__spans").to_pylist(), strict=True):
                    runs: list[list[int]] = []
                    for s, e in sorted((a["start"], min(a["stop"], len(x))) for a in raw or ()):
                        if runs and s <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], e)
                        else:
                            runs.append([s, e])
                    if words:
                        runs = [r for r in runs if _whole_words(x, *r) >= words]
                    ends = [0, *[v for r in runs for v in r], len(x)]
                    kept.append(b"".join(x[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2)))
                    merged.append([{"start": s, "stop": e} for s, e in runs])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(len(keep))], part.column("text"), pa.array([len(x) for x in texts], pa.int64()), pa.array(merged, span), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())],
                    names=[*[f"c{i}" for i in range(len(keep))], "text", "n_bytes", "spans", "kept"],
                )

    fields = "".join(f"c{i} {source.schema[f'c{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    out = source.mapInArrow(run, f"{fields}text binary, n_bytes long, spans array<struct<start int, stop int>>, kept {'string' if as_text else 'binary'}")
    place = {c: f"c{i}" for i, c in enumerate(keep)}
    return out.select(*[F.col(place[c]).alias(c) if c in place else F.col("text").cast(was_text).alias(c) for c in columns], "n_bytes", "spans", "kept")


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]))
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
