"""Operator 3, chat formatting by quotation linking (DataFrame operations only).

A message is cut into runs of lines of one quote level (the number of leading
``>``), and these at blank lines into passages. Quoted passages are hashed in
normalised form and joined, within their conversation, to the messages that
wrote them: the latest earlier turn with their whole run, or with that passage, or with
its first line, unquoted. A message replies to the latest turn that its first-level
quotes come from, else to the turn before it. Conversations are then built
without the quotes in the order of the replies: by the turn that is answered, then
by their own turn. So a message always comes after what it answers, and the
answers to a message stand together. They come in segments of SEGMENT messages; ``replies``
names each turn and what it replies to, in that order.

Messages are cut once, and the pieces written: keys of 64 bits for passages, and the
body. Linking and numbering read the narrow columns only. The as-of join
and the numbering work in blocks of BLOCK turns with what the
earlier blocks carry over, so that no task holds a conversation, however long,
nor all answers to one message.

Defined cases: a missing or empty text is a message without passages and with
an empty body; a missing role is `user`; rows without conv_id or turn can't be
placed and are left out; rows that repeat a turn stand in it by role and hash of the text,
equal rows once; a quote of nothing known is dropped from the body and counted
as not linked; ties go to the latest turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK, SEGMENT = 4096, 256
#: Leading quote marks, and control signs that part passages and lines while a message is cut.
MARKS = r"^[ ]?(?:>[ ]?)+"
PASSAGE, LEVEL, LINE = "\u0001", "\u0002", "\u0003"
#: Between the passages of a run; lines are not empty, so nothing else has two in a row.
BLANK = LINE + LINE


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), " ", ""))


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\f]+", " "))


def passages(text: Column) -> Column:
    """An array of (level, line) of a message: its lines, tidied, without marks."""
    clean = F.translate(F.coalesce(text, F.lit("")), PASSAGE + LEVEL + LINE, "")
    return F.transform(F.split(clean, "\n"), lambda x: F.struct(_level(x).alias("level"), _tidy(F.regexp_replace(x, MARKS, "")).alias("line")))


def _run(lines: Column) -> Column:
    return F.replace(lines, F.lit(BLANK), F.lit(LINE))


def _key(lines: Column) -> Column:
    return F.xxhash64(F.lower(F.translate(lines, LINE, " ")))


MESSAGE = ["conv_id", "turn", "role", "id"]


def cut(messages: DataFrame) -> DataFrame:
    """MESSAGE columns, body, the keys of what each row wrote, and the level and keys (run, passage, first line) of what it quotes."""
    raw = messages.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null and turn is not null")
    raw = raw.select("conv_id", "turn", "role", F.md5("text").alias("id"), passages(F.col("text")).alias("raw"))
    # gap is true after a blank line; raw is a column, as what a lambda names is worked out for each element
    after = F.transform("raw", lambda x, i: F.struct(x["level"].alias("level"), x["line"].alias("line"), F.coalesce(F.get("raw", i - 1)["line"] == "", F.lit(False)).alias("gap")))
    with_lines = raw.select(*MESSAGE, F.filter(after, lambda x: x["line"] != "").alias("lines"))

    def marked(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.element_at("lines", F.greatest(i, F.lit(1)))["level"])  # element_at counts from 1
        start = F.concat(F.lit(PASSAGE), x["level"].cast("string"), F.lit(LEVEL), x["line"])
        return F.when(before == x["level"], F.concat(F.when(x["gap"], F.lit(BLANK)).otherwise(F.lit(LINE)), x["line"])).otherwise(start)

    runs = F.filter(F.split(F.array_join(F.transform("lines", marked), ""), PASSAGE), lambda p: p != "")
    parts = F.transform(runs, lambda p: F.struct(F.split(p, LEVEL)[0].cast("int").alias("level"), F.split(p, LEVEL)[1].alias("lines")))
    own = F.transform(F.filter("parts", lambda p: p["level"] == 0), lambda p: p["lines"])
    units = F.flatten(F.transform("own", lambda p: F.concat(F.array(_run(p)), F.split(p, BLANK), F.split(_run(p), LINE))))

    def quoted(p: Column) -> Column:
        run = _key(_run(p["lines"]))
        return F.transform(F.split(p["lines"], BLANK), lambda x: F.struct(p["level"].alias("level"), F.array(run, _key(x), _key(F.split(x, LINE)[0])).alias("keys")))

    return with_lines.select(*MESSAGE, parts.alias("parts")).select(*MESSAGE, "parts", own.alias("own")).select(
        *MESSAGE, F.translate(_run(F.array_join("own", "\n")), LINE, "\n").alias("body"),
        F.array_distinct(F.transform(units, _key)).alias("wrote"),
        F.flatten(F.transform(F.filter("parts", lambda p: p["level"] > 0), quoted)).alias("quotes"),
    )


def origins(pieces: DataFrame) -> DataFrame:
    """MESSAGE, at, level, origin: the latest earlier turn that wrote what the passage number ``at`` quotes, if any did."""
    quoted = pieces.where(F.size("quotes") > 0).select(*MESSAGE, F.posexplode("quotes").alias("at", "q")).distinct()
    quoted = quoted.select(*MESSAGE, "at", F.col("q.level").alias("level"), F.posexplode("q.keys").alias("way", "key"))
    wrote = pieces.select("conv_id", "turn", F.explode("wrote").alias("key"))
    block = F.floor(F.col("turn") / BLOCK).alias("block")
    wrote, quoted = wrote.select("*", block), quoted.select("*", block)
    wrote = wrote.join(quoted.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi").distinct()
    # what earlier blocks carry over: a row a block with something written
    per = wrote.groupBy("conv_id", "key", "block").agg(F.max("turn").alias("last"))
    steps = per.unionByName(quoted.select("conv_id", "key", "block", F.lit(None).cast("bigint").alias("last")).distinct())
    steps = steps.groupBy("conv_id", "key", "block").agg(F.max("last").alias("last"))
    carried = steps.withColumn("carried", F.max("last").over(Window.partitionBy("conv_id", "key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    both = quoted.withColumn("made", F.lit(None).cast("bigint")).unionByName(wrote.withColumn("made", F.col("turn")), allowMissingColumns=True)
    w = Window.partitionBy("conv_id", "key", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("near", F.max("made").over(w)).where("made is null").join(carried, ["conv_id", "key", "block"], "left").withColumn("origin", F.coalesce("near", "carried"))
    # the run, else the passage, else its first line
    return found.groupBy(*MESSAGE, "at", "level").agg(F.min_by("origin", F.when(F.col("origin").isNotNull(), F.col("way"))).alias("origin"))


def replies(pieces: DataFrame) -> DataFrame:
    """MESSAGE, reply_to, n_quotes, n_linked of each distinct message."""
    summary = origins(pieces).groupBy(*MESSAGE).agg(F.count("*").alias("n_quotes"), F.count("origin").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("linked_turn"))
    known = pieces.select(*MESSAGE).distinct()
    # the turn before each, by blocks
    turns = pieces.select("conv_id", "turn").distinct().withColumn("block", F.floor(F.col("turn") / BLOCK))
    per = turns.groupBy("conv_id", "block").agg(F.max("turn").alias("last"))
    per = per.select("conv_id", "block", F.lag("last").over(Window.partitionBy("conv_id").orderBy("block")).alias("carried"))
    turns = turns.withColumn("near", F.lag("turn").over(Window.partitionBy("conv_id", "block").orderBy("turn"))).join(per, ["conv_id", "block"])
    turns = turns.select("conv_id", "turn", F.coalesce("near", "carried").alias("before"))
    out = known.join(summary, MESSAGE, "left").join(turns, ["conv_id", "turn"])
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select(*MESSAGE, F.coalesce("linked_turn", "before").alias("reply_to"), count("n_quotes"), count("n_linked"))


def ordered(messages: DataFrame) -> DataFrame:
    """``messages`` with ``position``: their number in the conversation by reply_to (none first), turn, role and id."""
    first = F.lit(-(1 << 62)).cast("bigint")
    m = messages.withColumns({"answered": F.coalesce("reply_to", first), "later": F.floor(F.col("turn") / BLOCK)})
    m = m.withColumn("block", F.floor(F.col("answered") / BLOCK))
    group = ["conv_id", "block", "answered", "later"]
    per = m.groupBy(*group).agg(F.count("*").alias("n"))
    blocks = per.groupBy("conv_id", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("conv_id", "block", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("block")) - F.col("n")).alias("before_block"))
    w = Window.partitionBy("conv_id", "block").orderBy("answered", "later")
    per = per.select(*group, (F.sum("n").over(w) - F.col("n")).alias("before_group")).join(blocks, ["conv_id", "block"])
    m = m.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy("turn", "role", "id"))).join(per, group)
    return m.select(*messages.columns, (F.col("before_block") + F.col("before_group") + F.col("rn") - 1).cast("bigint").alias("position"))


def linked_messages(messages: DataFrame) -> DataFrame:
    """MESSAGE, reply_to, n_quotes, n_linked, position and body of each message, repeated rows as often as they stand there."""
    pieces = written(cut(messages), "pieces")
    return ordered(replies(pieces)).join(pieces.select(*MESSAGE, "body"), MESSAGE)


def conversations(messages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, n_messages, n_quotes, n_linked, replies, chat): text in reply order, ``segment`` messages at a time."""
    m = linked_messages(messages).withColumn("segment", F.floor(F.col("position") / segment).cast("bigint"))
    chat = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "body", F.lit("\n<|end|>\n"))
    reply = F.concat(F.col("turn").cast("string"), F.lit(">"), F.coalesce(F.col("reply_to").cast("string"), F.lit("-")))
    row = F.struct("position", "n_quotes", "n_linked", reply.alias("reply"), chat.alias("chat"))
    # a set, so that repeated rows count once
    g = m.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_set(row)).alias("rows"))
    total = lambda name: F.aggregate("rows", F.lit(0).cast("bigint"), lambda n, x: n + x[name])
    return g.select(
        "conv_id", "segment", F.size("rows").cast("bigint").alias("n_messages"), total("n_quotes").alias("n_quotes"), total("n_linked").alias("n_linked"),
        F.array_join("rows.reply", " ").alias("replies"), F.array_join("rows.chat", "").alias("chat"))


SQL = rf"""
WITH known AS (
  SELECT DISTINCT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
messages AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn, role, text) AS id FROM known),
raw AS (
  SELECT id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT id, string_split(translate(text, chr(1) || chr(2) || chr(3), ''), chr(10)) AS l FROM messages)),
lines AS (
  SELECT id, pos, length(replace(regexp_extract(line, '^[ ]?(?:>[ ]?)+'), ' ', '')) AS level,
         trim(regexp_replace(regexp_replace(line, '^[ ]?(?:>[ ]?)+', ''), '[ \t\r\f]+', ' ', 'g')) AS line
  FROM raw),
gaps AS (SELECT *, coalesce(lag(line) OVER (PARTITION BY id ORDER BY pos) = '', false)::INT AS gap FROM lines),
full_lines AS (SELECT * FROM gaps WHERE line <> ''),
runs AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) - row_number() OVER (PARTITION BY id, level ORDER BY pos) AS run FROM full_lines),
numbered AS (SELECT *, sum(gap) OVER (PARTITION BY id, level, run ORDER BY pos) AS passage FROM runs),
whole AS (SELECT id, level, run, lower(string_agg(line, ' ' ORDER BY pos)) AS run_key FROM numbered GROUP BY id, level, run),
parts AS (
  SELECT id, level, run, passage, lower(string_agg(line, ' ' ORDER BY pos)) AS key, lower(arg_min(line, pos)) AS head
  FROM numbered GROUP BY id, level, run, passage),
wrote AS (
  SELECT conv_id, turn, run_key AS key FROM whole JOIN messages USING (id) WHERE level = 0
  UNION SELECT conv_id, turn, key FROM parts JOIN messages USING (id) WHERE level = 0
  UNION SELECT conv_id, turn, lower(line) FROM full_lines JOIN messages USING (id) WHERE level = 0),
quotes AS (SELECT p.*, run_key, conv_id, turn FROM parts p JOIN whole USING (id, level, run) JOIN messages USING (id) WHERE level > 0),
origins AS (
  SELECT q.id, q.level,
         coalesce((SELECT max(w.turn) FROM wrote w WHERE w.conv_id = q.conv_id AND w.key = q.run_key AND w.turn < q.turn),
                  (SELECT max(w.turn) FROM wrote w WHERE w.conv_id = q.conv_id AND w.key = q.key AND w.turn < q.turn),
                  (SELECT max(w.turn) FROM wrote w WHERE w.conv_id = q.conv_id AND w.key = q.head AND w.turn < q.turn)) AS origin
  FROM quotes q),
summary AS (SELECT id, count(*) AS n_quotes, count(origin) AS n_linked, max(CASE WHEN level = 1 THEN origin END) AS linked_turn FROM origins GROUP BY id),
turns AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM messages)),
bodies AS (SELECT id, string_agg(line, chr(10) ORDER BY pos) AS body FROM full_lines WHERE level = 0 GROUP BY id),
linked AS (
  SELECT m.*, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, coalesce(linked_turn, before) AS reply_to, coalesce(body, '') AS body
  FROM messages m JOIN turns USING (conv_id, turn) LEFT JOIN summary USING (id) LEFT JOIN bodies USING (id)),
built AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY reply_to NULLS FIRST, turn, role, md5(text)) - 1 AS position FROM linked)
SELECT conv_id, (position // {SEGMENT})::BIGINT AS segment, count(*)::BIGINT AS n_messages, sum(n_quotes)::BIGINT AS n_quotes, sum(n_linked)::BIGINT AS n_linked,
       string_agg(turn || '>' || coalesce(reply_to::VARCHAR, '-'), ' ' ORDER BY position) AS replies,
       string_agg('<|' || role || '|>' || chr(10) || body || chr(10) || '<|end|>' || chr(10), '' ORDER BY position) AS chat
FROM built GROUP BY conv_id, position // {SEGMENT}
"""
