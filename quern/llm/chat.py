"""Chat formatting by quotation linking, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, checked, table

#: Leading quote marks of a line: levels may be set apart by blanks.
QUOTE = r"^((?:[ \t]{0,3}>)+)[ \t]?"
#: Turns, and threads, whose rows are counted together at most.
BLOCK = 4096
#: A line that only says who is quoted.
ATTRIBUTION = r"(?i)^[ \t]*(?:on\b.{0,300}|.{1,120}\b)(?:wrote|writes|said):[ \t]*$"
#: Where a sentence ends: behind its mark, or at a blank line.
SENTENCE = r"(?<=[.!?])[\"')\]]*\s+|(?<=[。！？])|\n\s*\n"


def normalised(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _pieces(texts: Column) -> Column:
    """Hashes of the texts that are not blank when normalised, in order."""
    return F.transform(F.filter(F.transform(texts, normalised), lambda x: x != ""), lambda x: F.xxhash64(x))


def _runs(pieces: Column, counts: Column) -> Column:
    """Hashes (h1, h2) of each run of so many adjacent pieces."""
    of = lambda k: F.transform(F.sequence(F.lit(1), F.size(pieces) - k + 1), lambda i: _run(F.slice(pieces, i, k)))
    return F.flatten(F.transform(F.filter(counts, lambda k: k <= F.size(pieces)), of))


def _run(pieces: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(2), pieces).alias("h1"), F.xxhash64(F.lit(3), pieces).alias("h2"))


def link_quotations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rounds: int = 64) -> DataFrame:
    """Reply-ordered conversations without quotes, a row a message: all columns, and quote_depth, reply_to, root_turn, position, content, formatted.

    A line's quote level is the number of its leading marks. Consecutive lines of one level are a
    passage; it is normalised and hashed, and so are, for each message, its own passages (blank
    lines part them), their lines and its whole own text. A passage is also hashed as a run of so
    many lines and a run of so many sentences, and each of its lines and sentences alone; messages
    hash every run of their adjacent lines (blank ones left out) and sentences of the counts that the
    conversation's passages have. So a passage of some lines or sentences of a message, or of
    paragraphs whose blank line went, is found too, and of an altered one the lines or sentences that
    are whole; words within a sentence and line alone are not. A passage or piece belongs to the latest
    message of the same conversation with a lower turn that has one of its hashes; reply_to is the
    turn that the longest linked one of the least level belongs to (ties: the later turn): a message
    that only quotes at second hand answers what it quotes. root_turn is where the
    chain of replies starts. position counts a conversation's messages from 0 by (root_turn, turn):
    replies stand after what they answer, threads by their first message; without links this is
    the order of turns. content is the text without quoted lines and the lines that announce them;
    formatted is content between the role's markers.

    Nothing is gathered by conversation: hashes are joined by windows over (conversation, hash) in
    blocks of BLOCK turns, and over the blocks' last turns; chains are shortened by pointer jumping, and positions are counted in blocks of BLOCK turns of one
    thread, whose counts are added up by blocks of BLOCK threads. Null texts have null content and are formatted as empty. A null turn
    stands last and answers nothing; null conversations are one conversation; a null role is
    written as unknown. Rows repeated within a turn link alike and are numbered one after another. An empty table
    gives an empty result. Columns of the result's own names are replaced.
    """
    checked(messages, conv, turn, role, text)
    scratch = Scratch(messages.sparkSession, "chat")
    own = ("quote_depth", "reply_to", "root_turn", "position", "content", "formatted")
    messages = messages.drop(*own)
    c, t, body = F.col(f"`{conv}`"), F.col(f"`{turn}`").cast("long"), F.col(f"`{text}`")
    quoted = F.coalesce(body.rlike(f"(?m){QUOTE}"), F.lit(False))
    lines = F.split(body, "\r?\n", -1)
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 1), "[^>]", ""))
    plain = F.filter(lines, lambda x, i: (level(x) == 0) & ~(x.rlike(ATTRIBUTION) & (level(F.coalesce(F.try_element_at(lines, i + 2), F.lit(""))) > 0)))
    content = F.when(quoted, F.regexp_replace(F.regexp_replace(F.array_join(plain, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")).otherwise(body)
    rows = messages.withColumns({"__c": c, "__t": t, "__q": quoted, "content": content})
    rows = rows.withColumn("quote_depth", F.when(F.col("__q"), F.array_max(F.transform(lines, level))).otherwise(0).cast("int"))

    # passages that are quoted: (conversation, turn, level, number of the passage, its text)
    # rows that repeat a turn and text have one key, and their lines count once
    marked = rows.where("__q AND __t IS NOT NULL").select("__c", "__t", F.xxhash64("content", body).alias("m"), lines.alias("lines"))
    marked = marked.dropDuplicates(["__c", "__t", "m"]).select("__c", "__t", "m", F.posexplode("lines").alias("i", "line"))
    marked = marked.withColumns({"level": level(F.col("line")), "rest": F.regexp_replace("line", QUOTE, "")})
    by = W.partitionBy("__c", "__t", "m").orderBy("i")
    marked = marked.withColumn("new", (F.coalesce(F.lag("level").over(by), F.lit(-1)) != F.col("level")) | (F.trim("rest") == ""))
    marked = marked.withColumn("passage", F.sum(F.col("new").cast("int")).over(by))
    passages = marked.where("level > 0").groupBy("__c", "__t", "m", "level", "passage").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "rest"))), lambda x: x["rest"]).alias("parts"))
    said, sentences = normalised(F.array_join("parts", " ")), F.split(F.array_join("parts", " "), SENTENCE)
    passages = passages.withColumns({"said": said, "sentences": sentences}).where("said != ''")
    passages = passages.withColumns({"by_line": _pieces(F.col("parts")), "by_sentence": _pieces(F.col("sentences"))})
    whole = F.array(F.struct(F.xxhash64("said").alias("h1"), F.xxhash64(F.lit(1), "said").alias("h2"), F.length("said").alias("size")))
    sized = lambda run, size: F.struct(run["h1"].alias("h1"), run["h2"].alias("h2"), size.alias("size"))
    runs = F.transform(F.array("by_line", "by_sentence"), lambda x: sized(_run(x), F.length("said")))
    alone = F.transform(F.filter(F.transform(F.concat("parts", "sentences"), normalised), lambda x: x != ""), lambda x: sized(_run(F.array(F.xxhash64(x))), F.length(x)))
    passages = passages.select("__c", "__t", "level", F.size("by_line").alias("lines"), F.size("by_sentence").alias("sentences"), F.explode(F.concat(whole, runs, alone)).alias("u"))
    passages = passages.select("__c", "__t", "lines", "sentences", "level", "u.h1", "u.h2", "u.size").distinct()
    passages = scratch.save(passages, "passages")
    if passages.isEmpty():
        linked = rows.withColumns({"reply_to": F.lit(None).cast("long"), "root_turn": F.col("__t")})
    else:
        units = F.array_distinct(F.flatten(F.array(F.array("content"), F.split("content", r"\n\s*\n"), F.split("content", "\n"))))
        one = F.array(F.lit(1))
        counts = passages.groupBy(F.col("__c").alias("pc")).agg(F.array_union(F.collect_set("lines"), one).alias("lines"), F.array_union(F.collect_set("sentences"), one).alias("sentences"))
        said = rows.where("__t IS NOT NULL").join(counts, F.col("__c").eqNullSafe(F.col("pc")))
        texts = F.transform(F.filter(F.transform(units, normalised), lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2")))
        said = said.withColumns({"by_line": _pieces(F.split("content", "\n")), "by_sentence": _pieces(F.split("content", SENTENCE)), "texts": texts})
        said = said.select("__c", "__t", F.explode(F.concat("texts", _runs(F.col("by_line"), F.col("lines")), _runs(F.col("by_sentence"), F.col("sentences")))).alias("u")).select("__c", "__t", "u.h1", "u.h2").distinct()
        both = said.withColumns({"size": F.lit(None).cast("int"), "level": F.lit(None).cast("int"), "own": F.lit(True)}).unionByName(passages.drop("lines", "sentences").withColumn("own", F.lit(False)))
        # the latest earlier turn with the hash: within a block of turns, or else the last one of the blocks before
        both = both.withColumns({"block": F.floor(F.col("__t") / BLOCK), "mine": F.when(F.col("own"), F.col("__t"))})
        near = F.last("mine", ignorenulls=True).over(W.partitionBy("__c", "h1", "h2", "block").orderBy("__t").rangeBetween(W.unboundedPreceding, -1))
        ends = both.groupBy("__c", "h1", "h2", "block").agg(F.max("mine").alias("end"))
        far = F.last("end", ignorenulls=True).over(W.partitionBy("__c", "h1", "h2").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
        ends = ends.select(F.col("__c").alias("ec"), F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("block").alias("eb"), far.alias("far")).where("far IS NOT NULL")
        same = F.col("__c").eqNullSafe(F.col("ec")) & (F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2")) & (F.col("block") == F.col("eb"))
        found = both.withColumn("near", near).where("NOT own").join(ends, same, "left").withColumn("to", F.coalesce("near", "far")).where("to IS NOT NULL")
        replies = found.groupBy("__c", "__t").agg(F.max(F.struct(-F.col("level"), "size", "to"))["to"].alias("to")).select(F.col("__c").alias("rc"), F.col("__t").alias("rt"), "to")
        replies = scratch.save(replies.withColumn("root", F.col("to")), "replies-0")
        for k in range(1, rounds + 1):
            up = replies.select(F.col("rc").alias("uc"), F.col("rt").alias("ut"), F.col("root").alias("up"))
            step = replies.join(up, F.col("rc").eqNullSafe(F.col("uc")) & (F.col("root") == F.col("ut")), "left")
            step = scratch.save(step.select("rc", "rt", "to", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), f"replies-{k}")
            more = not step.where("moved").isEmpty()
            replies = step.drop("moved")
            if not more:
                break
        linked = rows.join(replies, F.col("__c").eqNullSafe(F.col("rc")) & (F.col("__t") == F.col("rt")), "left")
        linked = linked.withColumns({"reply_to": F.col("to"), "root_turn": F.coalesce("root", "__t")})
    # positions by prefix sums: over blocks of roots in a conversation, over blocks of turns in a block of roots, then in the latter
    content_hash = F.xxhash64(f"`{role}`", f"`{text}`")
    linked = linked.withColumns({"__p": F.floor(F.col("root_turn") / BLOCK), "__b": F.coalesce(F.floor(F.col("__t") / BLOCK), F.shiftright(content_hash, 50))})
    counts = linked.groupBy("__c", "__p", "root_turn", "__b").agg(F.count(F.lit(1)).alias("n"))
    blocks = counts.groupBy("__c", "__p").agg(F.sum("n").alias("n"))
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("__c").alias("bc"), F.col("__p").alias("bp"), ahead(W.partitionBy("__c").orderBy(F.col("__p").asc_nulls_last())).alias("earlier"))
    counts = counts.withColumn("ahead", ahead(W.partitionBy("__c", "__p").orderBy(F.col("root_turn").asc_nulls_last(), F.col("__b").asc_nulls_last())))
    counts = counts.join(blocks, F.col("__c").eqNullSafe(F.col("bc")) & F.col("__p").eqNullSafe(F.col("bp")))
    counts = counts.select(F.col("__c").alias("nc"), F.col("root_turn").alias("nr"), F.col("__b").alias("nb"), (F.col("earlier") + F.col("ahead")).alias("first"))
    within = F.row_number().over(W.partitionBy("__c", "root_turn", "__b").orderBy(F.col("__t").asc_nulls_last(), content_hash)) - 1
    out = linked.withColumn("__n", within).join(counts, F.col("__c").eqNullSafe(F.col("nc")) & F.col("root_turn").eqNullSafe(F.col("nr")) & F.col("__b").eqNullSafe(F.col("nb")))
    formatted = F.concat(F.lit("<|"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("unknown")), F.lit("|>\n"), F.coalesce("content", F.lit("")), F.lit("<|end|>\n"))
    return out.select(*[F.col(f"`{x}`") for x in messages.columns], "quote_depth", "reply_to", "root_turn", (F.col("first") + F.col("__n")).cast("long").alias("position"), "content", formatted.alias("formatted"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "quote_depth", "reply_to", "root_turn", "position", "content", "formatted")
