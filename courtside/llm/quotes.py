"""Quotation linking: chat messages without quotes, in reply order.

A line's quote level is the number of ``>`` that lead it (spaces and tabs
between them allowed). Consecutive lines of one level above zero are a quoted
passage; its normalised text (lower case, runs of anything but letters and
digits as one space) is hashed and joined to the messages that said it: their
whole unquoted text, a paragraph or a line of it, normalised the same way. The
original is the earliest message of the same conversation before the quoting
one, else the smallest (conv_id, turn) of another conversation.

A message replies to the original of its first level-one passage that is
linked within the conversation; threads follow these replies to their root,
and a conversation is ordered by (turn of the root, turn). All built-in
DataFrame functions: lines are arrays, originals are map-side combined
minima per hash, threads double their pointers per round, positions are
ranked per (root, 1,024 turns) and shifted by the counts before, summed per 64
roots and then per conversation, so no task gathers a conversation or a thread.

``conversations(partial=True)`` also links passages that no message said as a
whole, paragraph or line: to the earliest earlier message of the conversation
that holds all of the passage's lines, or all of its sentences (see ``held``).

Defined cases: null text counts as empty, null role as ``unknown``; rows with
a null conv_id or turn are kept without links, thread or position; repeated
rows keep one output row each (next to each other); rows that share a turn
are each other's equals and order by role and text; a passage without letters
or digits is dropped from the text and never linked; an unmatched passage
is dropped from the text and counted; an empty table gives an empty table;
extra columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_or_empty, written

LEAD = r"^((?:[ \t]*>)+)"
RANGE = 64  # root turns per range
TURNS = 1024  # turns of a thread per ranked block
SENTENCE = r"[.!?\u2026]+(?=\s|$)"


def normalised(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def parse(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, content, passages`` per row; ``passages`` is
    an array of (level, quote, said), in order, ``said`` its lines as they
    are, and ``content`` the unquoted text."""
    m = messages.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"),
                        text_or_empty("text").alias("text"))
    lines = F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n", -1)
    m = m.withColumn("quoted", F.col("text").rlike(r"(^|\n)[ \t]*>"))
    lead = lambda l: F.regexp_extract(l, LEAD, 1)
    cut = F.transform(lines, lambda l: F.struct(
        F.length(F.regexp_replace(lead(l), r"[^>]", "")).alias("level"),
        F.trim(F.substring(l, F.length(lead(l)) + 1, F.length(l))).alias("body"), l.alias("line")))
    none = F.array().cast("array<struct<level:int,body:string,line:string>>")
    m = m.withColumn("l", F.when(F.col("quoted"), cut).otherwise(none))
    n = F.size("l")
    level = lambda i: F.get("l", i)["level"]
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                      lambda i: (i < n) & ((i == 0) | (level(i) != level(i - 1))))
    m = m.withColumn("starts", F.when(n > 0, starts).otherwise(F.array().cast("array<int>")))
    def run(s: Column, j: Column) -> Column:
        bodies = F.transform(F.slice("l", s + 1, F.coalesce(F.get("starts", j + 1), n) - s), lambda x: x["body"])
        return F.struct(level(s).alias("level"), normalised(F.array_join(bodies, " ")).alias("quote"),
                        F.array_join(bodies, "\n").alias("said"))
    runs = F.transform("starts", run)
    own = F.array_join(F.transform(F.filter("l", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    return m.select("conv_id", "turn", "role", "text",
                    F.when(F.col("quoted"), F.trim(own, F.lit(" \n\t"))).otherwise(F.col("text")).alias("content"),
                    F.filter(runs, lambda r: r["level"] > 0).alias("passages"))


def originals(parsed: DataFrame) -> DataFrame:
    """``conv_id, key, turn``: what messages said, hashed; earliest turn per conversation."""
    parts = F.concat(F.array("content"), F.split("content", r"\n[ \t]*\n"), F.split("content", "\n"))
    said = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", "turn", F.explode(F.array_distinct(F.transform(parts, normalised))).alias("part"))
    return said.where("part <> ''").groupBy("conv_id", F.sha2("part", 256).alias("key")).agg(F.min("turn").alias("turn"))


def _units(pieces: Column) -> Column:
    """Sorted different hashes of the pieces with letters or digits."""
    return F.array_sort(F.array_distinct(F.transform(
        F.filter(F.transform(pieces, normalised), lambda p: p != ""), lambda p: F.sha2(p, 256))))


def held(parsed: DataFrame, passages: DataFrame) -> DataFrame:
    """``conv_id, turn, said, part_turn``: the earliest message of the conversation before ``turn``
    that holds every line of ``said``, or every sentence of it (line breaks within
    a sentence do not count); a message holds its lines, their sentences and those of its paragraphs.

    Different sets of parts are looked up once each, messages of the same parts as one, through
    the part of the set that the fewest messages hold; the others are verified by equi-joins.
    A set of one part needs the part's first message only."""
    blank, sentences = r"\n[ \t]*\n", lambda x: F.split(x, SENTENCE)
    lines = F.split("content", "\n")
    paragraphs = F.transform(F.split("content", blank), lambda x: F.replace(x, F.lit("\n"), F.lit(" ")))
    parts = F.concat(lines, F.flatten(F.transform(lines, sentences)), F.flatten(F.transform(paragraphs, sentences)))
    flat = F.replace("said", F.lit("\n"), F.lit(" "))
    asked = passages.select("conv_id", "turn", "said").distinct().select("*", F.explode(F.array(
        _units(F.split("said", "\n")), _units(sentences(flat)))).alias("units")).where("size(units) > 0")
    asked = written(asked.withColumn("set", F.sha2(F.concat_ws(",", "units"), 256)), "asked")
    sets = asked.select("conv_id", "set", "units").distinct()
    keys = sets.select("conv_id", "set", F.size("units").alias("n_units"), F.explode("units").alias("key"))
    messages = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", "turn", _units(parts).alias("units")).groupBy("conv_id", "units").agg(F.min("turn").alias("first"))
    postings = messages.select("conv_id", "first", F.sha2(F.concat_ws(",", "units"), 256).alias("message"),
                               F.explode("units").alias("key"))
    postings = written(postings.join(keys.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi"), "postings")
    spread = postings.groupBy("conv_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
    rarest = written(keys.join(spread, ["conv_id", "key"]).groupBy("conv_id", "set", "n_units").agg(
        F.count(F.lit(1)).alias("known"), F.min_by("key", F.struct("n", "key")).alias("key"),
        F.min("first").alias("first")).where("known = n_units"), "rarest")  # a part nobody said: no message holds the set
    one = rarest.where("n_units = 1").select("conv_id", "set", "first")
    candidates = rarest.where("n_units > 1").select("conv_id", "set", "n_units", "key").join(postings, ["conv_id", "key"])
    others = keys.join(rarest.select("conv_id", "set", F.col("key").alias("rare")), ["conv_id", "set"]).where("key <> rare")
    many = (candidates.drop("key").join(others.select("conv_id", "set", "key"), ["conv_id", "set"])
            .join(postings, ["conv_id", "key", "message", "first"], "left_semi")
            .groupBy("conv_id", "set", "message", "first", "n_units").count().where("count = n_units - 1"))
    found = one.unionByName(many.select("conv_id", "set", "first")).groupBy("conv_id", "set").agg(F.min("first").alias("first"))
    return asked.join(found, ["conv_id", "set"]).where("first < turn").groupBy("conv_id", "turn", "said").agg(
        F.min("first").alias("part_turn"))


def links(parsed: DataFrame, partial: bool = False) -> DataFrame:
    """One row per quoted passage with letters or digits: ``conv_id, turn, role, text, seq,
    level, linked_conv, linked_turn`` (null where no message said it).
    Repeated rows count once. With ``partial`` a passage that no earlier message of the
    conversation said as one goes to the earliest that holds all its parts."""
    quotes = parsed.where("size(passages) > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", "turn", "role", "text", F.posexplode("passages").alias("seq", "p")).select(
        "conv_id", "turn", "role", "text", "seq", "p.level", F.sha2("p.quote", 256).alias("key"), "p.said",
        (F.col("p.quote") != "").alias("speaks")).where("speaks").drop("speaks").distinct()
    quotes = written(quotes, "quotes")
    said = originals(parsed).join(quotes.select("key").distinct(), "key", "left_semi")  # only what is quoted
    said = written(said, "originals")
    here = said.select("conv_id", "key", F.col("turn").alias("first_turn"))
    anywhere = said.groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("o"))
    # The smallest message of another conversation: the runner-up where the smallest is of this one.
    runner = said.join(anywhere.select("key", F.col("o.conv_id").alias("c")), "key").where("conv_id <> c").groupBy(
        "key").agg(F.min(F.struct("conv_id", "turn")).alias("o2"))
    q = quotes.join(here, ["conv_id", "key"], "left").join(anywhere, "key", "left").join(runner, "key", "left")
    inside = F.col("first_turn") < F.col("turn")
    if partial:
        q = written(q, "whole")
        parts = held(parsed, q.where(~F.coalesce(inside, F.lit(False))))
        q = q.join(parts, ["conv_id", "turn", "said"], "left")
        q = q.withColumn("first_turn", F.when(inside, F.col("first_turn")).otherwise(F.col("part_turn")))
    other = F.when(F.col("o.conv_id") != F.col("conv_id"), F.col("o")).otherwise(F.col("o2"))
    return q.select("conv_id", "turn", "role", "text", "seq", "level",
                    F.when(inside, F.col("conv_id")).otherwise(other["conv_id"]).alias("linked_conv"),
                    F.when(inside, F.col("first_turn")).otherwise(other["turn"]).alias("linked_turn"))


def _roots(replies: DataFrame) -> DataFrame:
    """``conv_id, turn, root`` of replying turns: pointer doubling, one written table per round."""
    r = written(replies.select("conv_id", "turn", F.col("reply_to").alias("root")), "threads")
    while True:
        up = r.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"))
        nxt = written(r.join(up, ["conv_id", "root"], "left").select(
            "conv_id", "turn", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "threads")
        r = nxt.select("conv_id", "turn", "root")
        if not nxt.where("moved").limit(1).count():
            return r


def conversations(messages: DataFrame, partial: bool = False) -> DataFrame:
    """One row per message: ``conv_id, turn, role, position`` (from 0, in reply order),
    ``thread_turn``, ``reply_to`` (turn), ``n_quotes`` (passages), ``n_linked``,
    ``content`` and ``formatted`` (``<|role|>``, line break, content, line break).
    ``partial``: passages also link by their lines or sentences."""
    parsed = written(parse(messages), "messages")
    found = written(links(parsed, partial), "links")
    # A turn's links are those of its first row (by role and text) that has any.
    inner = found.where("level = 1 AND linked_conv = conv_id")
    reply = inner.groupBy("conv_id", "turn").agg(
        F.min_by("linked_turn", F.struct("role", "text", "seq")).alias("reply_to"))
    counts = found.groupBy("conv_id", "turn", "role", "text").agg(F.count("linked_turn").alias("n_linked"))
    roots = _roots(reply)
    placed = (parsed.join(reply, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
              .join(counts, ["conv_id", "turn", "role", "text"], "left")
              .withColumn("thread_turn", F.when(F.col("conv_id").isNotNull(), F.coalesce("root", "turn")))
              .withColumn("rng", F.floor(F.col("thread_turn") / RANGE)).withColumn("block", F.floor(F.col("turn") / TURNS)))
    named = placed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    nameless = placed.where("conv_id IS NULL OR turn IS NULL").withColumn("position", F.lit(None).cast("long"))
    # Rows before: of earlier ranges, of the range's earlier blocks, of the block itself.
    earlier = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    blocks = named.groupBy("conv_id", "rng", "thread_turn", "block").agg(F.count(F.lit(1)).alias("n"))
    ranges = blocks.groupBy("conv_id", "rng").agg(F.sum("n").alias("n")).select(
        "conv_id", "rng", F.coalesce(F.sum("n").over(earlier("conv_id").orderBy("rng")), F.lit(0)).alias("outer"))
    inner = F.sum("n").over(earlier("conv_id", "rng").orderBy("thread_turn", "block"))
    before = blocks.withColumn("inner", F.coalesce(inner, F.lit(0))).join(ranges, ["conv_id", "rng"]).select(
        "conv_id", "rng", "thread_turn", "block", (F.col("outer") + F.col("inner")).alias("before"))
    w = W.partitionBy("conv_id", "rng", "thread_turn", "block").orderBy("turn", "role", "text")
    ranked = named.withColumn("rn", F.row_number().over(w)).join(
        before, ["conv_id", "rng", "thread_turn", "block"]).withColumn("position", F.col("before") + F.col("rn") - 1)
    cols = ["conv_id", "turn", "role", "position", "thread_turn", "reply_to",
            F.size("passages").cast("long").alias("n_quotes"),
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "content",
            F.concat(F.lit("<|"), "role", F.lit("|>\n"), "content", F.lit("\n")).alias("formatted")]
    return ranked.select(*cols).unionByName(nameless.select(*cols))


def transcripts(conversation: DataFrame, max_messages: int = 256) -> DataFrame:
    """Formatted text of conversations, in chunks of at most ``max_messages``
    messages: ``conv_id, chunk, messages, transcript``."""
    c = conversation.where("position IS NOT NULL").withColumn("chunk", F.floor(F.col("position") / max_messages))
    return c.groupBy("conv_id", "chunk").agg(
        F.count("*").alias("messages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "formatted"))),
                                 lambda x: x["formatted"]), "").alias("transcript"))


# The same result as DuckDB SQL over conversations(conv_id, turn, role, text).
SQL = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS row_id, conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         regexp_matches(coalesce(text, ''), '(^|\n)[ \t]*>') AS quoted
  FROM conversations),
l AS (
  SELECT row_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line,
         generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS i
  FROM m WHERE quoted),
lv AS (
  SELECT row_id, i, line, length(replace(replace(lead, ' ', ''), chr(9), '')) AS level,
         trim(substr(line, length(lead) + 1)) AS body
  FROM (SELECT *, regexp_extract(line, '^((?:[ \t]*>)+)', 1) AS lead FROM l)),
runs AS (
  SELECT row_id, level, min(i) AS seq,
         trim(lower(regexp_replace(string_agg(body, ' ' ORDER BY i), '[^\p{L}\p{N}]+', ' ', 'g'))) AS quote
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row_id, level ORDER BY i) AS g FROM lv)
  GROUP BY row_id, level, g HAVING level > 0),
own AS (
  SELECT row_id, trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(10) || chr(9)) AS content
  FROM lv WHERE level = 0 GROUP BY row_id),
p AS (
  SELECT m.*, CASE WHEN quoted THEN coalesce(own.content, '') ELSE text END AS content,
         (SELECT count(*) FROM runs WHERE runs.row_id = m.row_id) AS n_quotes
  FROM m LEFT JOIN own USING (row_id)),
parts AS (
  SELECT conv_id, turn, content AS part FROM p
  UNION ALL SELECT conv_id, turn, unnest(regexp_split_to_array(content, '\n[ \t]*\n')) FROM p
  UNION ALL SELECT conv_id, turn, unnest(string_split(content, chr(10))) FROM p),
said AS (
  SELECT conv_id, k, min(turn) AS turn
  FROM (SELECT conv_id, turn, trim(lower(regexp_replace(part, '[^\p{L}\p{N}]+', ' ', 'g'))) AS k FROM parts
        WHERE conv_id IS NOT NULL AND turn IS NOT NULL) WHERE k <> '' GROUP BY 1, 2),
q AS (
  SELECT DISTINCT conv_id, turn, role, text, seq, level, quote
  FROM runs JOIN p USING (row_id) WHERE quote <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
inside AS (
  SELECT q.*, said.turn AS linked_turn
  FROM q LEFT JOIN said ON said.conv_id = q.conv_id AND said.k = q.quote AND said.turn < q.turn),
linked AS (
  SELECT inside.*, linked_turn IS NOT NULL
         OR EXISTS (SELECT 1 FROM said WHERE said.k = inside.quote AND said.conv_id <> inside.conv_id) AS hit
  FROM inside),
reply AS (
  SELECT conv_id, turn, arg_min(linked_turn, (role, text, seq)) AS reply_to
  FROM linked WHERE level = 1 AND linked_turn IS NOT NULL GROUP BY 1, 2),
climb AS (
  SELECT conv_id, turn, reply_to AS root FROM reply
  UNION ALL
  SELECT c.conv_id, c.turn, r.reply_to FROM climb c JOIN reply r ON r.conv_id = c.conv_id AND r.turn = c.root),
roots AS (SELECT conv_id, turn, min(root) AS root FROM climb GROUP BY 1, 2),
hits AS (SELECT conv_id, turn, role, text, count(*) AS n_linked FROM linked WHERE hit GROUP BY 1, 2, 3, 4),
placed AS (
  SELECT p.conv_id, p.turn, p.role, p.text, p.content, p.n_quotes, reply_to,
         CASE WHEN p.conv_id IS NOT NULL THEN coalesce(root, p.turn) END AS thread_turn,
         coalesce(n_linked, 0) AS n_linked
  FROM p LEFT JOIN reply ON reply.conv_id = p.conv_id AND reply.turn = p.turn
  LEFT JOIN roots ON roots.conv_id = p.conv_id AND roots.turn = p.turn
  LEFT JOIN hits ON hits.conv_id = p.conv_id AND hits.turn = p.turn AND hits.role = p.role AND hits.text = p.text)
SELECT conv_id, turn, role,
       CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN row_number() OVER (
         PARTITION BY conv_id, turn IS NULL ORDER BY thread_turn, turn, role, text) - 1 END AS position,
       thread_turn, reply_to, n_quotes, n_linked, content,
       '<|' || role || '|>' || chr(10) || content || chr(10) AS formatted
FROM placed"""
