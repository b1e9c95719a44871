"""MinHash near-dedup with bottom-k sketches of one hash function."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checked, row_keys, table, text_slices
from .graph import components

#: Least values that a class retains: the sketch that has inverted lists and that similarity is estimated from.
LISTED = 40
#: A list of so many classes at most is paired in full; in longer ones each class meets its neighbours.
SHORT = 8
#: Long lists in which a class is looked up, and rows, and values of their sets, of a list that a task compares with as many others.
LOOKED_UP, PART, VALUES = 10, 1024, 1 << 20

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; A-Z are folded, white space splits.

    A word's hash is its polynomial modulo 2^64, taken from running sums and mixed; a shingle's is
    made of its words' hashes in order. With fewer words the whole sequence is one shingle.
    """
    x = np.frombuffer(text.translate(_FOLD), np.uint8)
    solid = np.concatenate([[False], ~_BLANK[x], [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(x) + 1, np.uint64)
    power = np.full(len(x), _BASE)
    power[0] = 1
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * np.cumprod(power), out=sums[1:])
    back = np.full(int(start[-1]) + 1, _INVERSE)
    back[0] = 1
    word = _mix((sums[stop] - sums[start]) * np.cumprod(back)[start] + (stop - start).astype(np.uint64))
    n = max(1, len(word) - words + 1)
    h = np.full(n, min(words, len(word)), np.uint64)
    for k in range(min(words, len(word))):
        h = _mix(h * np.uint64(0x2545F4914F6CDD1D) + word[k : k + n])
    return np.unique(h)


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32), pa.array(flat))


def _arrays(column) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _signatures(words: int):
    def run(batches):
        for batch in batches:
            for start, texts in text_slices(batch):
                sets = [shingles(x, words) for x in texts]
                whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(3)], pa.array([len(s) for s in sets], pa.int64()), pa.array(whole[:, 0]), pa.array(whole[:, 1]), _lists([s[:LISTED] for s in sets])], names=["id", "k1", "k2", "n", "s1", "s2", "low"])

    return run


def _pairs(batches):
    """All pairs of the lists, of SHORT rows at most, whose rows come sorted by v; a list may span batches."""
    v_open, held = None, []
    for b in batches:
        out: list[tuple[int, int]] = []
        for v, c in zip(b.column("v").to_pylist(), b.column("cid").to_pylist(), strict=True):
            if v != v_open:
                out += combinations(held, 2)
                v_open, held = v, []
            held.append(c)
        yield _pair_batch(out)
    yield _pair_batch(list(combinations(held, 2)))


def _neighbours(batches):
    """Each row of a list with the one before it; rows come sorted."""
    last_v = last = None
    for b in batches:
        if not b.num_rows:
            continue
        v, c = b.column("v").to_numpy(), b.column("cid").to_numpy()
        same = np.append(last_v == v[0] if last_v is not None else False, v[1:] == v[:-1])
        before = np.append(c[0] if last is None else last, c[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(f(c, before)[same]) for f in (np.minimum, np.maximum)], names=["a", "b"])
        last_v, last = v[-1], c[-1]


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]}), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])


def estimate(a: np.ndarray, b: np.ndarray, k: int = LISTED) -> float:
    """Jaccard similarity estimated on the k least values of the union of two bottom-k sketches."""
    both = np.concatenate([a, b])
    both.sort()
    again = both[1:] == both[:-1]
    union = both[np.concatenate([[True], ~again])][:k]
    if not len(union):
        return 0.0
    return float((both[1:][again] <= union[-1]).sum()) / len(union)


def _kept(batches, least: float):
    for batch in batches:
        good = [i for i, (x, y) in enumerate(zip(_arrays(batch.column("x")), _arrays(batch.column("y")), strict=True)) if estimate(x, y) >= least]
        yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))


def _verified(batches, percent: int):
    for batch in batches:
        good = []
        for i, (x, y) in enumerate(zip(_arrays(batch.column("x")), _arrays(batch.column("y")), strict=True)):
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= percent * (len(both) - common):
                good.append(i)
        yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have 100 * intersection >= percent * union: all columns, and n_shingles, component_id, kept.

    Documents with equal sets are one class, so exact copies are never paired. Each class keeps the
    LISTED least values of its set under one hash function. Classes of a value's inverted list are
    candidates: in lists of up to SHORT classes each pair; in longer ones, sorted by the values that
    follow, each class with its neighbour, with the list's first and with its smallest set, which a
    template has that others only add to. Similarity is estimated on the
    pair's union sketch; pairs five standard deviations below the threshold go. The rest is
    verified on whole sets. Components of these links follow.

    Long lists then need one more look. Pairs that share a value of a short list met there; a pair
    that shares long lists only must have as many of them in common as the estimate demands, so
    every class with so many values in long lists is looked up, whatever its other values are, and
    none that the estimate would let through is left out. Where such classes of a long list are in different components, those outside the
    list's largest component are compared with all that are in others, in tiles: bounded by the
    values that no other set of the tile has, estimated, and verified on whole sets in the same
    task, until one link to the other's component is found. No pair but a link leaves a task, and no
    list is capped. A class is looked up in its LOOKED_UP
    least long lists; two linked ones share none of them with a chance of 0.2 ^ LOOKED_UP at most.

    Null texts and texts without words have an empty set and link with nothing. Repeated rows link
    with each other. component_id is the smallest id that links reach; a null id names a component
    only if it is alone. An empty table gives an empty result. Columns of the result's own names are
    replaced.
    """
    docs = docs.drop("n_shingles", "component_id", "kept")
    key = F.col(f"`{id}`")
    group = F.coalesce("__first.id", key)
    return _grouped(docs, words, percent, id, text).select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__n").alias("n_shingles"), group.alias("component_id"), key.eqNullSafe(group).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near copies: of each component the row of the smallest (id, content hash), null ids last.

    Components are those of near_duplicates. One is told by its row, not by its id: of different
    documents with null ids or with one repeated id each is kept. Rows without a set link with
    nothing and are kept; of rows that repeat id and text one is kept, with a set or without.
    """
    rows = _grouped(docs, words, percent, id, text)
    own = F.col("__first").isNull() | ((F.col("__first.k1") == F.col("__k1")) & (F.col("__first.k2") == F.col("__k2")))
    return rows.where(own).dropDuplicates(["__k1", "__k2"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def _grouped(docs: DataFrame, words: int, percent: int, id: str, text: str) -> DataFrame:
    """All columns, row keys __k1 and __k2, the set's size __n and __first: the first row (none, id, k1, k2) of the component, null without a set."""
    checked(docs, id, text)
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "minhash")
    key, body = F.col(f"`{id}`"), F.col(f"`{text}`")
    kind = docs.schema[id].dataType.simpleString()
    keyed = docs.withColumns(dict(zip(("__k1", "__k2"), row_keys(key, body), strict=True)))
    slim = keyed.select(key.alias("id"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), body.cast("binary").alias("text"))
    sets = scratch.save(slim.mapInArrow(_signatures(words), f"id {kind}, k1 long, k2 long, n long, s1 long, s2 long, low array<long>"), "sets")
    classes = sets.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("at"), F.first("n").alias("n"), F.first("low").alias("low"))
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    entries = classes.select("cid", "n", "low", F.posexplode("low").alias("place", "v"))
    entries = entries.select("cid", "n", "v", "place", F.try_element_at("low", F.col("place") + 2).alias("v2"), F.try_element_at("low", F.col("place") + 3).alias("v3"))
    sizes = entries.groupBy("v").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("n", "cid"))["cid"].alias("least"), F.min(F.struct("v2", "v3", "cid"))["cid"].alias("first")).where("size > 1")
    listed = scratch.save(entries.join(sizes, "v"), "lists")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = listed.where(F.col("size") <= SHORT).select("v", "cid").repartition(n, "v").sortWithinPartitions("v").mapInArrow(_pairs, "a long, b long")
    # long lists of low places are enough here: a group of copies has the same values in them; no list is one task
    long, order = listed.where((F.col("size") > SHORT) & (F.col("place") < 8)), ("v", "v2", "v3", "cid")
    pairs = pairs.union(long.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_neighbours, "a long, b long"))
    for hub in ("least", "first"):
        pairs = pairs.union(long.select(F.least("cid", hub), F.greatest("cid", hub)))
    pairs = pairs.where("a < b").distinct()
    pairs = scratch.save(pairs, "pairs")
    inner = _link(spark, scratch, slim, classes, pairs, words, percent, "first")
    roots = components(inner, scratch, "roots-first")
    state = classes.select("cid", "n", F.size("low").alias("have")).join(roots, F.col("cid") == F.col("node"), "left").select("cid", "n", "have", F.coalesce("root", "cid").alias("root"))
    rest = scratch.save(_rest(listed, state, percent), "rest")
    if not rest.isEmpty():
        values = scratch.save(_values(slim, classes.join(rest.select("cid").distinct(), "cid"), words), "second-sets")
        more = rest.join(values, "cid").groupBy("v", "part", "block").applyInArrow(_compare(percent), "a long, b long")
        more = scratch.save(more, "second-links")
        roots = components(inner.union(more), scratch, "roots-second")
    member = classes.select("s1", "s2", "cid", "at").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    first = member.groupBy("root").agg(F.min("at").alias("first"))
    member = member.join(first, "root").select("s1", "s2", "first")
    found = sets.select(F.col("k1").alias("__a"), F.col("k2").alias("__b"), F.col("n").alias("__n"), "s1", "s2").join(member, ["s1", "s2"], "left").drop("s1", "s2")
    found = found.groupBy("__a", "__b").agg(F.first("__n").alias("__n"), F.first("first").alias("__first"))
    return keyed.join(found, (F.col("__k1") == F.col("__a")) & (F.col("__k2") == F.col("__b")))


def _rest(listed: DataFrame, state: DataFrame, percent: int) -> DataFrame:
    """Tiles of classes that long lists alone may link: (v, part, block, outside, cid, root, looked).

    A row for each long list that holds more than one component; members are dealt to parts, those
    outside the largest component, which meet every part, to blocks.
    """
    long = listed.where(F.col("size") > SHORT).select("cid", "v", "place")
    frequent = long.groupBy("cid").agg(F.count(F.lit(1)).alias("long"), F.sort_array(F.collect_list("v")).alias("all"))
    # a partner lists min(have, percent * n) values at least, of which a tile demands this share in common
    enough = F.col("long") >= F.lit(_least(percent)) * F.least(F.col("have"), F.ceil(F.col("n") * percent / 100))
    inside = state.join(frequent, "cid").where(enough).select("cid", "n", "root", F.slice("all", 1, LOOKED_UP).alias("looked")).withColumn("v", F.explode("looked"))
    each = inside.groupBy("v", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    split = each.groupBy("v").agg(F.count(F.lit(1)).alias("roots"), F.sum("m").alias("m"), F.sum("w").alias("w"), F.max(F.struct("m", "root", "w")).alias("big")).where("roots > 1")
    tasks = lambda m, w: F.greatest(F.ceil(m / PART), F.ceil(w / VALUES))
    split = split.select("v", F.col("big.root").alias("big"), tasks(F.col("m"), F.col("w")).alias("parts"), tasks(F.col("m") - F.col("big.m"), F.col("w") - F.col("big.w")).alias("blocks"))
    inside = inside.join(split, "v")
    part, block = F.pmod(F.xxhash64("cid"), F.col("parts")), F.pmod(F.xxhash64("cid"), F.col("blocks"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = inside.select("v", part.alias("part"), upto("blocks").alias("block"), F.lit(False).alias("outside"), "cid", "root", "looked")
    outside = inside.where("root != big").select("v", upto("parts").alias("part"), block.alias("block"), F.lit(True).alias("outside"), "cid", "root", "looked")
    return members.union(outside)


def _compare(percent: int):
    out, least = pa.schema([("a", pa.int64()), ("b", pa.int64())]), _least(percent)

    def tile(key, t):
        t = t.combine_chunks()
        v, side = key[0].as_py(), t["outside"].to_numpy(zero_copy_only=False)
        cid, root = t["cid"].to_numpy(), t["root"].to_numpy()
        sets, looked = _arrays(t["values"].chunk(0)), t["looked"].to_pylist()
        # a pair belongs to the first list that both are looked up in
        before = [{x for x in l if x < v} for l in looked]
        inner, links = np.flatnonzero(~side), []
        size = np.array([len(x) for x in sets], np.int64)
        met = _met(sets, cid)
        alone = size - met
        inner = inner[np.argsort(alone[inner], kind="stable")]
        sizes, alone_in, met_in = size[inner], alone[inner], met[inner]
        lows = np.concatenate([sets[i][:LISTED] for i in inner] or [np.zeros(0, np.uint64)])
        low_sizes = np.minimum(sizes, LISTED)
        order = np.argsort(lows, kind="stable")
        lows, owner = lows[order], np.repeat(np.arange(len(inner)), low_sizes)[order]
        for o in np.flatnonzero(side):
            x = sets[o]
            # a union has what is alone on either side: rows with more of that than x leaves room for are not looked at
            k = int(np.searchsorted(alone_in, 100 * met[o] // percent - len(x), "right"))
            may = (root[inner[:k]] != root[o]) & (100 * met_in[:k] >= percent * (sizes[:k] + alone[o]))
            if not may.any():
                continue
            shared = _shared(lows, owner, len(inner), x[:LISTED])[:k]
            may &= shared >= least * np.minimum(low_sizes[:k], min(LISTED, len(x)))
            at = np.flatnonzero(may)
            for j in at[np.argsort(-shared[at], kind="stable")]:
                i = inner[j]
                if root[i] == root[o] or before[i] & before[o]:
                    continue
                common = len(np.intersect1d(x, sets[i], assume_unique=True))
                if 100 * common >= percent * (len(x) + len(sets[i]) - common):
                    links.append((cid[o], cid[i]))
                    root = np.where(root == root[i], root[o], root)
        return pa.table([np.array([x[k] for x in links], np.int64) for k in (0, 1)], schema=out)

    return tile


def _met(sets: list[np.ndarray], cid: np.ndarray) -> np.ndarray:
    """How many values of each set another class's set has; a class may have two rows."""
    _, one, row = np.unique(cid, return_index=True, return_inverse=True)
    sizes = np.array([len(sets[i]) for i in one], np.int64)
    values, owner = np.concatenate([sets[i] for i in one]), np.repeat(np.arange(len(one)), sizes)
    order = np.argsort(values, kind="stable")
    values, same = values[order], np.zeros(len(values), bool)
    same[1:] = values[1:] == values[:-1]
    same[:-1] |= same[1:]
    return np.bincount(owner[order[same]], minlength=len(one))[row]


def _shared(values: np.ndarray, owner: np.ndarray, n: int, x: np.ndarray) -> np.ndarray:
    """How many values each of n arrays has in common with x; values of all, ascending, and whose each is."""
    first, last = np.searchsorted(values, x), np.searchsorted(values, x, "right")
    return np.bincount(np.concatenate([owner[a:b] for a, b in zip(first, last, strict=True)]), minlength=n)


def _least(percent: int) -> float:
    """Estimates on LISTED values below it are five standard deviations under the threshold."""
    return percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / LISTED) ** 0.5


def _values(slim: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """The whole shingle set of each class: (cid, values), from its representative's text."""

    def whole(batches):
        for batch in batches:
            for start, texts in text_slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column("cid").slice(start, len(texts)), _lists([shingles(x, words) for x in texts])], names=["cid", "values"])

    texts = slim.join(classes.select("cid", "at.k1", "at.k2"), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return texts.select("cid", "text").mapInArrow(whole, "cid long, values array<long>")


def _link(spark: SparkSession, scratch: Scratch, slim: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """The pairs that are links, by estimate and then by whole sets."""

    def both(p: DataFrame, sets: DataFrame, values: str) -> DataFrame:
        return p.join(sets.select(F.col("cid").alias("a"), F.col(values).alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col(values).alias("y")), "b").select("a", "b", "x", "y")

    limit = _least(percent)
    likely = scratch.save(both(pairs, classes, "low").mapInArrow(lambda it: _kept(it, limit), "a long, b long"), f"{name}-likely")
    nodes = likely.select(F.col("a").alias("cid")).union(likely.select("b")).distinct()
    full = scratch.save(_values(slim, classes.join(nodes, "cid"), words), f"{name}-sets")
    return scratch.save(both(likely, full, "values").mapInArrow(lambda it: _verified(it, percent), "a long, b long"), f"{name}-links")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")
