"""The training-data operators against brute force, with nulls, empty and repeated rows, ties and extra columns."""

import hashlib
import random
import re

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from quern.llm import bpe, chat, common, graph, html, minhash, mixing, quality, sharding, suffixes, topk, vectors

WORDS = [f"w{i}" for i in range(300)]


def corpus(seed=0, n=60):
    r = random.Random(seed)
    say = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    shared, docs = say(120), []
    for i in range(n):
        docs.append(say(r.randrange(1, 200)) + (f" {shared} " + say(30) if i % 3 == 0 else ""))
    for i in range(10):
        words = docs[i].split()
        words[r.randrange(len(words))] = "changed"
        docs.append(" ".join(words))
    return [*docs, docs[3], docs[3], "", None, "a", "A", "é" * 900, " \t ", "x" * 1000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 0) for i, t in enumerate(corpus())]
    rows += [rows[4], (None, "a b c d e f", None, "s1", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


def empty(df):
    return df.where("false")


def test_suffixes(docs):
    length = 128
    rows = suffixes.repeated_spans(docs.withColumn("spans", F.lit(1)), length=length).collect()
    texts = [(r["text"] or "").encode() for r in rows]
    seen = {}
    for x in texts:
        for i in range(len(x) - length + 1):
            seen[x[i : i + length]] = seen.get(x[i : i + length], 0) + 1
    for r, x in zip(rows, texts, strict=True):
        cover = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        assert bytes(r["kept"]) == bytes(b for b, c in zip(x, cover, strict=True) if not c)
        assert [(s["start"], s["stop"]) for s in r["spans"]] == [m.span() for m in re.finditer(b"\1+", bytes(cover))] and r["n_bytes"] == len(x)
    assert sum(len(r["spans"]) > 0 for r in rows) > 15 and suffixes.repeated_spans(empty(docs)).count() == 0


def test_suffixes_split(docs, monkeypatch):
    """Hot keys split by deeper bytes, small buckets, texts in small chunks: the same spans."""
    want = {(r["doc_id"], bytes(r["kept"])) for r in suffixes.repeated_spans(docs, length=128).collect()}
    for name, value in (("HOT", 2), ("BUCKET", 3), ("CHUNK", 100)):
        monkeypatch.setattr(suffixes, name, value)
        assert {(r["doc_id"], bytes(r["kept"])) for r in suffixes.repeated_spans(docs, length=128).collect()} == want


def test_suffixes_hot_key(spark, monkeypatch):
    """One passage in many texts, with edits near it: every class of its anchors has the same key, some strings repeat."""
    monkeypatch.setattr(suffixes, "HOT", 8)
    r = random.Random(12)
    say = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    shared, edge = say(30), [say(20) for _ in range(6)]
    texts = [f"{say(9)} {r.choice(edge)[: r.randrange(60)]}{shared[r.randrange(30) : 160 - r.randrange(60)]}{r.choice(edge)[: r.randrange(60)]} {say(9)}" for _ in range(300)]
    rows = suffixes.repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), length=100).collect()
    seen = {}
    for x in texts:
        for i in range(len(x) - 99):
            seen[x[i : i + 100]] = seen.get(x[i : i + 100], 0) + 1
    for row in rows:
        x, cover = row["text"], bytearray(len(row["text"]))
        for i in range(len(x) - 99):
            if seen[x[i : i + 100]] > 1:
                cover[i : i + 100] = b"\1" * 100
        assert [(s["start"], s["stop"]) for s in row["spans"]] == [m.span() for m in re.finditer(b"\1+", bytes(cover))]
    assert 20 < sum(len(row["spans"]) > 0 for row in rows) < 300


def test_suffixes_words(spark):
    """With `words`, runs of fewer whole words stay."""
    r = random.Random(13)
    say = lambda k: " ".join(r.choice(WORDS) + str(r.randrange(10**6)) for _ in range(k))
    long, short = say(30), say(15)
    texts = [f"{say(8)} {x} {say(8)}" for x in (long, long, short, short)]
    for words, want in ((0, [1, 1, 1, 1]), (20, [1, 1, 0, 0])):
        rows = sorted(suffixes.repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=100, words=words, as_text=True).collect())
        assert [len(x["spans"]) for x in rows] == want and all((s in x["kept"]) == (n == 0) for x, s, n in zip(rows, (long, long, short, short), want, strict=True))
    assert suffixes._whole_words(b"one two three four", 2, 11) == 1 and suffixes._whole_words(b"one two three", 4, 13) == 2


def test_multikey_quicksort():
    r = np.random.default_rng(1)
    values = [bytes(r.integers(0, 3, r.integers(0, 40), np.uint8)) for _ in range(2000)]
    rows, lengths = suffixes._padded(values, 40)
    order = suffixes.multikey_quicksort(rows, lengths)
    assert [values[i].ljust(40, b"\0") for i in order] == sorted(v.ljust(40, b"\0") for v in values)


def brute_components(rows, words, percent):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return set() if not w else {tuple(w)} if len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                c = len(sets[i] & sets[j])
                if sets[i] and sets[j] and root[i] != root[j] and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                    old, new = max(root[i], root[j]), min(root[i], root[j])
                    root = [new if x == old else x for x in root]
    least = {x: min((rows[i][0] for i in range(len(rows)) if root[i] == x and rows[i][0] is not None), default=None) for x in set(root)}
    return sorted((rows[i][0], len(sets[i]), least[root[i]]) for i in range(len(rows)) if rows[i][0] is not None)


@pytest.mark.parametrize("short", [8, 2])
def test_minhash(docs, monkeypatch, short):
    monkeypatch.setattr(minhash, "SHORT", short)
    found = minhash.near_duplicates(docs.withColumn("component_id", F.lit("clash")), words=4).collect()
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 4, 80)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found) and minhash.near_duplicates(empty(docs)).count() == 0


def test_minhash_own_values(spark):
    """A copy with so many own values among its least ones that it meets its partners in long lists of high places only."""
    r = random.Random(6)
    say = lambda k: [f"v{r.randrange(10**9)}" for _ in range(k)]
    words = sorted(say(5000), key=lambda w: int(minhash.shingles(w.encode(), 1)[0]))
    low, base, high = words[:55], r.sample(words[60:4000], 500), words[4000:]
    rows = [(0, " ".join(base))] + [(i, " ".join(base + say(100))) for i in range(1, 30)]
    rows += [(40 + k, " ".join(base + low[a : a + k] + r.sample(high, 100 - k))) for a, k in ((0, 17), (17, 18), (35, 20))]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=1).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in found) == brute_components(rows, 1, 80)
    assert {x["component_id"] for x in found} == {0}


def test_minhash_template(spark, monkeypatch):
    """A template, many texts that add a fifth of their own to it (linked to it alone), some that add more, and other ones; small tiles."""
    for name, value in (("PART", 16), ("VALUES", 9000)):
        monkeypatch.setattr(minhash, name, value)
    r = random.Random(16)
    say = lambda k: " ".join(f"v{r.randrange(10**9)}" for _ in range(k))
    base, other = say(200), say(30)
    texts = [f"{base} {say(50)}" for _ in range(70)] + [base] + [f"{base} {say(60)}" for _ in range(20)] + [f"{other} {' '.join(base.split()[:190])}" for _ in range(3)] + [f"{other} {say(200)}", base[:20], ""]
    rows = [(i, x) for i, x in enumerate(texts, 5)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), words=1).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in found) == brute_components(rows, 1, 80)
    assert sum(x["component_id"] == 5 for x in found) >= 71


def test_minhash_long_texts(spark):
    """Whole sets of tens of thousands of words, one word, one word of great length."""
    r = random.Random(17)
    long = [str(r.randrange(10**7)) for _ in range(30_000)]
    rows = [(0, " ".join(long)), (1, " ".join(long[2000:])), (2, " ".join(long[8000:])), (3, "x" * 500_000), (4, "x" * 500_000 + "y"), (5, "one"), (6, " ONE ")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert sorted((x["doc_id"], x["component_id"]) for x in found) == [(i, c) for i, _, c in brute_components(rows, 4, 80)]


@pytest.mark.parametrize("at_once", [graph.TASK_LINKS, 7])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(graph, "TASK_LINKS", at_once)
    r = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(x := r.randrange(200, 400), x + 200 * r.randrange(2)) for _ in range(90)] + [(7, 7), (5, 4), (0, 1)]
    root = {x: x for link in links for x in link}
    for _ in range(60):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in links if a != b for x in (a, b)}
    frame = spark.createDataFrame(links, "a long, b long").repartition(4)
    found = graph.components(frame, common.Scratch(spark, "test"), "graph")
    assert sorted(map(tuple, found.collect())) == sorted((x, root[x]) for x in linked)
    assert graph.components(empty(frame), common.Scratch(spark, "test"), "graph").count() == 0


def test_quality(spark):
    r = random.Random(2)
    good = [" ".join(r.choice(WORDS) for _ in range(40)) + "." for _ in range(120)]
    bad = [" ".join(r.choice(WORDS) + "###" for _ in range(40)) for _ in range(120)]
    texts = [*good, *bad, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)] + [(5, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == len(texts) and all(0 <= x["score"] <= 1 for x in rows)
    out = [x for x in rows if x["held_out"] and x["doc_id"] < 240]
    assert len(out) > 30 and sum((x["score"] >= 0.7) == (x["doc_id"] < 120) for x in out) / len(out) > 0.95
    assert {x["score"] for x in quality.quality_scores(docs, empty(labels)).collect()} == {0.5} and quality.quality_scores(empty(docs), labels).count() == 0
    kept = quality.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and 100 < kept.count() < 140


def test_top_k(spark):
    r = np.random.default_rng(3)
    x = [[float(v) for v in r.integers(-3, 4, 6) / 4] for _ in range(330)]
    rows = [(i, v) for i, v in enumerate(x)] + [(400, None), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (600, [float("nan")] * 6), (None, x[0]), (700, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for row in topk.exact_top_k(df, df.where("vec_id % 100 = 0"), 10, scale=1024.0).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
    e = [[int(np.floor(1024 * v)) for v in row] for row in x]
    for qid in (0, 100, 200, 300):
        want = sorted(((i, sum(a * b for a, b in zip(e[qid], e[i], strict=True))) for i in range(330) if i != qid), key=lambda p: (-p[1], p[0]))[:10]
        assert got[qid] == want
    assert set(got) == {0, 100, 200, 300} and topk.exact_top_k(empty(df), empty(df)).count() == 0


def jump(key, n):
    key, b, j = key & (1 << 64) - 1, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(docs):
    rows = sharding.shard_documents(docs.withColumn("slot", F.lit("clash")), 24).collect()
    assert all(r["shard"] == jump(r["shard_key"], 24) and r["grown_shard"] in (r["shard"], 24) and r["grown_shard"] == jump(r["shard_key"], 25) for r in rows)
    for s in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert len(rows) == docs.count() and sharding.shard_documents(empty(docs)).count() == 0


def test_bpe(docs):
    ranks, pattern = bpe.load_ranks(), bpe.default_pattern()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.round_trip(bpe.decode_ids(bpe.encode_texts(docs))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r["text"] or ""
        ids = enc.encode_ordinary(text)
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == text.encode()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    coder, r = bpe.MergeReplay(ranks, pattern), random.Random(4)
    for _ in range(200):
        text = "".join(r.choice("aaab bcé  \n\t漢🙂12'sl") for _ in range(r.randrange(80)))
        assert coder.encode([text])[0] == enc.encode_ordinary(text)
    texts = ["".join(r.choice("ab c.'d\n\t\r\x0b\u00a0\u3000\x1c\u2028\u0085é漢9 ") for _ in range(r.randrange(60))) for _ in range(800)]
    texts += ["a" * 50_000, "xyz" * 9000, " " * 7000, "0" * 3001, ""]
    assert coder.encode(texts) == [enc.encode_ordinary(x) for x in texts]
    assert coder.units and bpe.MergeReplay(ranks, r"\S+|\s+").units is None


def test_bpe_order(monkeypatch):
    """A vocabulary whose merges make pairs of lower ranks: a word's lowest rank, leftmost, is always next."""
    r = random.Random(14)
    ranks = {bytes([b]): 400 + b for b in range(256)}
    for i in range(300):
        token = bytes(r.choice(b"abc") for _ in range(r.randrange(2, 6)))
        ranks.setdefault(token, r.randrange(10**5) * 1000 + 700 + i)
    ranks = {t: i for i, t in enumerate(sorted(ranks, key=ranks.get))}
    coder = bpe.MergeReplay(ranks, r"\S+|\s+")
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 40))) for _ in range(400)]
    assert coder.encode(words) == [coder.merge(w.encode()) for w in words]
    enc = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    lone = [w for w in words if w.encode() not in ranks]
    assert coder.encode(lone) == [enc.encode_ordinary(w) for w in lone]


def test_bpe_lots(docs, monkeypatch):
    """Lots of a few texts give what one lot gives; a long word, repeated rows, clashing names, no rows."""
    long = docs.limit(5).withColumn("text", F.lit("ab" * 30_000)).union(docs).withColumn("ids_sha256", F.lit(1))
    want = sorted(tuple(x) for x in bpe.round_trip(long).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").na.fill(-1).collect())
    monkeypatch.setattr(bpe, "UNITS", 50)
    assert sorted(tuple(x) for x in bpe.round_trip(long).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").na.fill(-1).collect()) == want
    assert len(want) == docs.count() + 5 and bpe.round_trip(empty(docs)).count() == 0 and bpe.encode_texts(empty(docs)).count() == 0


def test_chat(spark):
    rows = [
        (1, 0, "user", "Hello there, how are you?\n\nWhat is the plan?"), (1, 1, "assistant", "Fine."), (1, 2, "user", "On Monday Bob wrote:\n> What is\n> the PLAN?\n\nThis one."),
        (1, 3, "assistant", "> > what is the plan\n> This one.\nYes."), (2, 0, None, None), (2, None, "user", "> nothing known\nok"), (None, 0, "user", ""), (2, 0, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    got = {(r["conv_id"], r["turn"]): r for r in chat.link_quotations(df).collect()}
    assert (got[1, 2]["reply_to"], got[1, 2]["content"], got[1, 2]["quote_depth"]) == (0, "This one.", 1)
    assert (got[1, 3]["reply_to"], got[1, 3]["root_turn"], got[1, 3]["quote_depth"], got[1, 3]["content"]) == (2, 0, 2, "Yes.")
    assert [got[1, t]["position"] for t in (0, 2, 3, 1)] == [0, 1, 2, 3] and got[2, None]["content"] == "ok" and got[2, None]["reply_to"] is None
    assert got[1, 1]["formatted"] == "<|assistant|>\nFine.<|end|>\n" and chat.link_quotations(df).count() == len(rows) and chat.link_quotations(empty(df)).count() == 0


def test_chat_parts(spark):
    """Quotes of some lines, of a sentence, of paragraphs whose blank line went, and of an altered passage."""
    four = "The first of lines\nA second line here\nThen the third one\nAnd a fourth"
    rows = [
        (1, 0, four), (1, 1, "Nothing to see."), (1, 2, "> A second line here\n> then the THIRD one\nYes."),
        (1, 3, "Then the third one"), (1, 4, "> A second line here\n> Then the third one\nStill."), (1, 5, "> Then the third one\nNow."),
        (2, 0, "We met at noon. The plan is (as said) to wait. Nobody minds!\n\nA further paragraph. It ends here."), (2, 1, "Other words."),
        (2, 2, "> The plan is (as said) to wait.\nFine."), (2, 3, "> Nobody minds!\n> A further paragraph. It ends here.\nGood."), (2, 4, "> We met at noon. The plan is\n> (as said) to wait.\nSo."),
        (2, 5, "> Nobody minds! Words that no one said\nHm."), (2, 6, "> nothing of this\n> was ever said\nOh."), (3, 0, four), (3, 1, ">> And a fourth\nDeep."), (None, 0, four), (None, 1, "> A second line here\n> Then the third one"),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").repartition(3)
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in chat.link_quotations(df).collect()}
    want = {(1, 2): 0, (1, 4): 0, (1, 5): 3, (2, 2): 0, (2, 3): 0, (2, 4): 0, (2, 5): 0, (3, 1): 0, (None, 1): 0}
    assert got == {(c, t): want.get((c, t)) for c, t, _ in rows}


def test_chat_positions(spark, monkeypatch):
    """A thread that most turns answer, turns without one, rows without a turn, in blocks of 4."""
    monkeypatch.setattr(chat, "BLOCK", 4)
    rows = [(1, 3, "user", "the first thing"), (1, 5, "user", "the second thing")]
    rows += [(1, t, "user", f"> the {'second' if t % 5 == 0 else 'first'} thing\nanswer {t}" if t % 3 else f"remark {t}") for t in range(6, 60)]
    rows += [(1, None, "user", f"no turn {k}") for k in range(9)] + [(2, t, "user", "again") for t in (1, 1, 9)]
    got = chat.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    high = 10**9
    for conv in (1, 2):
        place = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["position"])
        assert [r["position"] for r in place] == list(range(len(place)))
        keys = [(high if r["root_turn"] is None else r["root_turn"], high if r["turn"] is None else r["turn"]) for r in place]
        assert keys == sorted(keys)
    assert sum(r["root_turn"] == 3 for r in got) > 25 and sum(r["root_turn"] == 5 for r in got) > 5


def plain_replies(rows):
    """(conversation, turn) -> the turn that is answered, by comparing texts and not hashes."""
    import regex

    fold = lambda x: regex.sub(r"[^\p{L}\p{N}]+", " ", x.lower()).strip()
    pieces = lambda xs: [y for y in map(fold, xs) if y]
    level = lambda x: m[0].count(">") if (m := re.match(chat.QUOTE, x)) else 0
    parsed, counts = {}, {}
    for c, t, _, text in set(rows):
        lines = re.split("\r?\n", text)
        announces = lambda i: re.search(chat.ATTRIBUTION, lines[i]) and i + 1 < len(lines) and level(lines[i + 1])  # noqa: B023, E731
        content = "\n".join(x for i, x in enumerate(lines) if not level(x) and not announces(i)).strip()
        passages, last = [], -1
        for x in lines:
            rest = re.sub(chat.QUOTE, "", x)
            if level(x) != last or not rest.strip(" "):
                passages.append((level(x), []))
            passages[-1][1].append(rest)
            last = level(x)
        units = []
        for deep, parts in passages:
            joined = " ".join(parts)
            said, by_line, by_sentence = fold(joined), pieces(parts), pieces(re.split(chat.SENTENCE, joined))
            if deep and said:
                n_lines, n_sentences = counts.setdefault(c, ({1}, {1}))
                n_lines.add(len(by_line))
                n_sentences.add(len(by_sentence))
                units += [(deep, len(said), said), (deep, len(said), tuple(by_line)), (deep, len(said), tuple(by_sentence))]
                units += [(deep, len(x), (x,)) for x in by_line + by_sentence]
        parsed.setdefault((c, t), []).append((content, units))
    own = {}
    for (c, t), messages in parsed.items():
        for content, _ in messages:
            has = own.setdefault((c, t), set())
            has.update(pieces([content, *re.split(r"\n\s*\n", content), *content.split("\n")]))
            for split, sizes in zip((content.split("\n"), re.split(chat.SENTENCE, content)), counts.get(c, ((), ())), strict=True):
                p = pieces(split)
                has.update(tuple(p[i : i + k]) for k in sizes for i in range(len(p) - k + 1))
    out = {}
    for (c, t), messages in parsed.items():
        found = []
        for deep, size, unit in (u for _, units in messages for u in units):
            to = max((x for (d, x), has in own.items() if d == c and x < t and unit in has), default=None)
            if to is not None:
                found.append((-deep, size, to))
        out[c, t] = max(found)[2] if found else None
    return out


def test_chat_plain(spark, monkeypatch):
    """Generated threads, nested, repeated and cross-quoted, against plain comparison of texts; turns in blocks of 4."""
    monkeypatch.setattr(chat, "BLOCK", 4)
    rng = np.random.default_rng(5)
    words = "red blue green one two three stone river light house wind snow".split()
    pick = lambda *x: x[rng.integers(len(x))]
    sentence = lambda: pick("Yes.", "I agree.", *[" ".join(rng.choice(words, rng.integers(2, 6))).capitalize() + pick(".", "!", "?") for _ in range(6)])
    fresh = lambda: pick("\n", "\n\n").join(pick(" ", "\n").join(sentence() for _ in range(rng.integers(1, 4))) for _ in range(rng.integers(1, 4)))
    mark = lambda x: "\n".join(pick("> ", ">") + y for y in x.split("\n"))
    rows = []
    for c in range(40):
        texts = []
        for t in range(14):
            parts = []
            for _ in range(rng.integers(0, 3) if texts else 0):
                x = texts[rng.integers(len(texts))]
                some = x.split("\n")
                i = rng.integers(len(some))
                x = pick(x, x, "\n".join(some[i : i + 2]), some[i].split(". ")[0], x.replace("\n\n", "\n"), x.upper(), mark(x))
                parts.append(pick("", "", "Bob wrote:\n") + mark(x) + pick("\n", "\n\n"))
            texts.append("".join(parts) + pick(fresh(), fresh(), sentence(), ""))
            rows += [(c, t, "user", texts[-1])] * int(pick(1, 1, 1, 2))
        rows.append((c, 5, "user", fresh()))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {}
    for r in chat.link_quotations(df).collect():
        got.setdefault((r["conv_id"], r["turn"]), set()).add(r["reply_to"])
    want = plain_replies(rows)
    assert {k: v for k, v in got.items() if v != {want[k]}} == {} and sum(v is not None for v in want.values()) > 200
    links = [(c, t, r) for (c, t), r in want.items() if r is not None]
    assert any(t // 4 > r // 4 for _, t, r in links) and any(t // 4 == r // 4 for _, t, r in links)


def test_mixing(docs):
    mixed = mixing.mix_sources(docs, F.regexp_count("text", F.lit(mixing.WORD)))
    rows = mixed.collect()
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r["size"] for r in rows if r["source"] == s) for s in sources}
    weight, target, stopped = {s: i % 3 + 1 for i, s in enumerate(sources)}, {}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in stopped)
        target = {s: 3 * size[s] if s in stopped else left * weight[s] / sum(weight[x] for x in sources if x not in stopped) for s in sources}
        if not (more := {s for s in sources if target[s] > 3 * size[s] + 1e-9}):
            break
        stopped |= more
    for s in sources:
        own = [r for r in rows if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == size[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= max(r["size"] for r in own)
    assert all(r["taken"] == r["size"] * r["passes"] <= 3 * r["size"] and len(r["positions"]) == r["passes"] for r in rows)
    again = {(r["doc_id"], r["text"]): r["taken"] for r in mixing.mix_sources(docs.repartition(3), F.regexp_count("text", F.lit(mixing.WORD))).collect()}
    assert again == {(r["doc_id"], r["text"]): r["taken"] for r in rows} and mixing.mix_sources(empty(docs), F.length("text")).count() == 0
    order = [x["position"] for x in mixing.training_order(mixed).collect()]
    assert order == sorted(order) and len(order) == sum(r["passes"] for r in rows)
    by_first = mixing.training_order(mixed, each_pass=False).collect()
    assert [x["position"] for x in by_first if x["passes"]] == sorted(x["positions"][0] for x in rows if x["passes"]) and len(by_first) == len(rows) and not any(x["passes"] for x in by_first[sum(x["passes"] > 0 for x in rows) :])
    # the schedules add up: what stands before a position is about as much as the position says
    total, before = sum(size.values()), 0
    for x in mixing.training_order(mixed).collect():
        assert abs(x["position"] - before) < 0.1 * total
        before += x["size"]
    assert mixing.mix_sources(docs.withColumn("positions", F.lit("clash")).withColumn("size", F.lit(1)), F.length("text")).count() == len(rows)


def test_vectors(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(60, 16))
    x = np.vstack([base, base[:20] + 0.08 * r.normal(size=(20, 16)), base[:20] + 0.08 * r.normal(size=(20, 16)), base[:5], 2 * base[:3]])
    rows = [(i, [float(v) for v in row], i % 2) for i, row in enumerate(x)] + [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("inf")] * 16, 0), (203, [float(v) for v in x[0]], None), (204, [1.0, None], 1), (205, [float(v) for v in x[1]], 1), (205, [float(v) for v in x[1]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vectors.near_duplicate_vectors(df.withColumn("kept", F.lit("clash"))).collect()
    good = [i for i, (_, v, y) in enumerate(rows) if v and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in good}
    links = {i: {j for j in good if j != i and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.93} for i in good}
    want = sum(map(len, links.values()))
    assert want > 40 and 0.9 * want <= sum(g["n_links"] for g in got) <= want and len(got) == len(rows)
    assert all(g["n_links"] == 0 and g["component_id"] == g["vec_id"] and g["kept"] for g in got if 200 <= g["vec_id"] < 205)
    assert all(g["kept"] == (g["vec_id"] == g["component_id"]) for g in got) and vectors.near_duplicate_vectors(empty(df)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><a href=/>Home</a></nav>
<div class="sidebar">Side <p>bar</div>@@<div id="comments"><p>Nice one, I liked it very much indeed, thanks a lot for it.</p></div><form><p>Your mail</p></form><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    body = "<h1>Title &amp; more</h1><p>First   paragraph is long enough to count, with a <a href='x>y'>link</a>, and goes on.<p>Second\n one<br>with a break, which is long enough as well to be read.</p><ul><li>One item of some length<li>Two</ul><!-- <p>no</p> -->"
    want = "Title & more\n\nFirst paragraph is long enough to count, with a link, and goes on.\n\nSecond one with a break, which is long enough as well to be read.\n\nOne item of some length\n\nTwo"
    for wrap in ("<article>{}</article>", "<main><div>{}</div></main>", "<div class='content'>{}</div>"):
        assert html.main_text(PAGE.replace("@@", wrap.replace("{}", body))) == want
    pages = spark.createDataFrame([(1, "u", f"<article>{body}</article>"), (2, "u", None), (3, "u", ""), (4, None, "<p"), (5, "u", "<div>" * 5000 + "deep"), (1, "u", "plain & text")], "page_id long, url string, html string").withColumn("n_chars", F.lit("clash"))
    got = {(r["page_id"], r["text"]): r["n_chars"] for r in html.extract_pages(pages).collect()}
    assert got[1, want] == len(want) and got[2, ""] == got[3, ""] == 0 and got[1, "plain & text"] == 12 and html.extract_pages(empty(pages)).count() == 0
    assert any(k[0] == 5 and k[1] == "deep" for k in got)


def test_html_names():
    """Class names count as whole tokens only, never inside an article, for headings, or for most of the page's text."""
    para = "<p>A paragraph of the article that is long enough to count, and then goes on for some more words.</p>"
    text = "A paragraph of the article that is long enough to count, and then goes on for some more words."
    body = f"<h2 id='related-work'>Related</h2>{para}<section id='discussion'><h2 class='menu'>Talk</h2>{para}</section><div class='notice'>{para}</div><div id='search-algorithms'>{para}</div>"
    want = "\n\n".join(["Related", text, "Talk", text, text, text])
    for wrap in ("<article class='post has-sidebar'>{}</article>", "<main class='no-sidebar'>{}</main>", "<div class='site no-sidebar'><article>{}</article></div>", "<div class='sidebar'><article class='widget'>{}</article></div>"):
        page = PAGE.replace("@@", wrap.replace("{}", body))
        assert html.main_text(page) == want
    plain = f"<h2 id='related-work'>Related</h2>{para}<section id='discussion'><h2 class='menu'>Talk</h2>{para}</section>"
    for wrap in ("<div class='content with-sidebar'>{}</div>", "<div class='widget'>{}</div>", "<div id='sidebar'>{}</div>"):
        assert html.main_text(PAGE.replace("@@", wrap.replace("{}", plain))) == "\n\n".join(["Related", text, "Talk", text])
    many = "".join(f"<p>Comment {k} is long as well, and it is not of the article.</p>" for k in range(30))
    assert html.main_text(f"<body><article>{para}</article><div class='comments'>{many}</div></body>") == text
    assert html.main_text(f"<body><div class='widget'>{para}</div><div class='widget'>{para}</div></body>") == f"{text}\n\n{text}"


def test_html_inside():
    """Adverts, reader comments and sidebars go within an article too, but not where it has no other text."""
    para = "<p>A paragraph of the article that is long enough to count, and then goes on for some more words.</p>"
    text = "A paragraph of the article that is long enough to count, and then goes on for some more words."
    extra = f"<div class='box ad'>Buy this</div><aside>Side</aside><section id=comments><h3>Readers</h3>{'<div class=comment>I like it, and I say so at length here.</div>' * 9}</section><div class='sidebar'>Links</div>"
    for wrap in ("<article>{}</article>", "<main><div>{}</div></main>", "<main><article>{}</article></main>", "<div class='page'><article><div>{}</div></article></div>"):
        assert html.main_text(PAGE.replace("@@", wrap.replace("{}", para + extra + para))) == f"{text}\n\n{text}"
    assert html.main_text(f"<body><article><div class='sidebar'>{para}</div></article></body>") == text
    assert html.main_text(f"<body><main><article class='sponsored'>{para}</article><p>x</p></main></body>").startswith(text)
    assert "said of ads" in html.main_text(f"<body><article>{para}<section class='ads-history'><h2 class='ads'>Ads</h2><p>What was said of ads</p></section></article></body>")


def test_pipeline(spark, tmp_path):
    from quern.llm import pipeline as corpus_pipeline

    for t in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        n, docs = docs.count(), stage(spark, docs, str(tmp_path))
        if i < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            docs.write.parquet(str(tmp_path / f"s{i}"))
            docs = spark.read.parquet(str(tmp_path / f"s{i}"))
            assert i == 3 or docs.count() <= n
    rows = docs.collect()
    assert rows and sorted(tuple(r) for r in rows) == sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_near_copies_ids(spark):
    """Null and repeated ids: different texts stay, of near copies and repeated rows one stays, whatever their ids."""
    from quern.llm import pipeline as corpus_pipeline

    r = random.Random(8)
    say = lambda k: [r.choice(WORDS) for _ in range(k)]
    alone = [" ".join(say(50)) for _ in range(9)]
    group = say(200)
    near = [" ".join([*group[:-1], f"end{k}"]) for k in range(4)]
    pair = [" ".join([*alone[8].split(), f"end{k}"]) for k in range(2)]
    rows = [(None, x) for x in alone[:3]] + [(7, x) for x in alone[3:6]] + [(8, alone[6]), (8, alone[6])]
    rows += [(7, near[0]), (7, near[1]), (None, near[2]), (9, near[3]), (None, pair[0]), (None, pair[1]), (None, None), (10, ""), (11, None), (12, alone[7])]
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    got = [(x["doc_id"], x["text"]) for x in kept.collect()]
    single = [(i, x) for i, x in dict.fromkeys(rows) if x not in near and x not in pair]
    assert kept.columns == list(corpus_pipeline.COLUMNS) and set(single) <= set(got) and len(got) == len(single) + 2
    assert sum(x in near[:2] and i == 7 for i, x in got) == 1 and sum(x in pair and i is None for i, x in got) == 1
    again = [(x["doc_id"], x["text"]) for x in corpus_pipeline.keep_one_of_near_copies(spark, docs.repartition(2), "").collect()]
    assert set(again) == set(got) and corpus_pipeline.keep_one_of_near_copies(spark, empty(docs), "").count() == 0


def test_clashing_columns(spark):
    """Columns that bear the results' or helpers' own names change no result, and repeated rows stay."""
    r = random.Random(21)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(40))), f"s{i % 2}") for i in range(40)]
    docs = spark.createDataFrame([*rows, rows[3], rows[3], (None, None, None)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    n, words = 43, F.regexp_count("text", F.lit(mixing.WORD))
    runs = {
        "quality": (lambda d: quality.quality_scores(d, labels), ("doc_id", "held_out", "score"), ("score", "held_out", "quality", "k1")),
        "bpe": (bpe.encode_texts, ("doc_id", "ids"), ("ids", "n_tokens", "k1")),
        "mixing": (lambda d: mixing.mix_sources(d, words), ("doc_id", "size", "source_size", "target", "taken"), ("size", "target", "taken", "k1")),
    }
    for run, columns, extra in runs.values():
        plain = run(docs).select(*columns).collect()
        clash = run(docs.withColumns({c: F.lit("clash") for c in extra})).select(*columns).collect()
        assert len(plain) == n and sorted(map(repr, plain)) == sorted(map(repr, clash))


def test_cut_repeats(spark):
    """The stage against a plain version: planted passages of over 50 words, shorter ones, characters of many bytes, null ids and texts."""
    from quern.llm import pipeline as corpus_pipeline

    r = random.Random(22)
    say = lambda k: " ".join(r.choice(["é", "", "漢"]) + f"{r.choice(WORDS)}{r.randrange(10**5)}" for _ in range(k))
    long, short, edge = say(60), say(40), say(51)
    texts = [f"{say(r.randrange(30))} {x} {say(r.randrange(30))}" for x in (long, long, long, short, short, edge, edge, f"{long} {short}")]
    texts += [say(80) for _ in range(5)] + ["", None, long]
    rows = [(None if i == 2 else i, x, "en", None, 0) for i, x in enumerate(texts)] + [(9, texts[9], "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    length, seen = corpus_pipeline.PASSAGE_BYTES, {}
    raw = [(i, (x or "").encode()) for i, x, *_ in rows]
    for _, x in raw:
        for i in range(len(x) - length + 1):
            seen[x[i : i + length]] = seen.get(x[i : i + length], 0) + 1
    want = []
    for key, x in raw:
        cover = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        for m in re.finditer(b"\1+", bytes(cover)):
            inside = [w for w in re.finditer(rb"[^\x20\x09-\x0D]+", x) if m.start() <= w.start() and w.end() <= m.end()]
            if len(inside) < corpus_pipeline.PASSAGE_WORDS:
                cover[m.start() : m.end()] = bytes(m.end() - m.start())
        want.append((key, bytes(b for b, c in zip(x, cover, strict=True) if not c).decode("utf-8", "ignore")))
    got = corpus_pipeline.cut_repeats(spark, docs, "")
    found = got.collect()
    assert got.columns == list(corpus_pipeline.COLUMNS) and sorted(map(repr, want)) == sorted(repr((x["doc_id"], x["text"])) for x in found)
    assert all(x["n_chars"] == len(x["text"]) for x in found) and not any(long in x["text"] or edge in x["text"] for x in found)
    assert sum(short in x["text"] for x in found) == 2 and corpus_pipeline.cut_repeats(spark, empty(docs), "").count() == 0
