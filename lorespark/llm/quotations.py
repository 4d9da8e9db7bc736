"""Reply-ordered conversations by quotation linking, in DataFrame functions only.

Lines that start with ``>`` are quoted, one level for each mark. Neighbouring non-blank lines of one level are a passage.
Passages are normalised (lower case, white space as one blank), hashed, and joined to the earliest message of the
conversation that wrote the same passage or line itself; the passages themselves are compared too. Only conversations
in which something is quoted are taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

MARKS = "^(?:> ?)+"


def content(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"[ \t\n\x0B\f\r]+", " "))


def units(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, message, level, whole, unit): normalised passages (whole) and lines, level 0 for a message's own."""
    lines = messages.select("conv_id", "turn", "message", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select(
        "conv_id", "turn", "message", "pos",
        F.length(F.regexp_replace(F.regexp_extract("line", MARKS, 0), "[^>]", "")).alias("level"),
        content(F.col("line")).alias("unit"),
    ).where("unit <> ''")
    run = F.col("pos") - F.row_number().over(Window.partitionBy("conv_id", "turn", "message", "level").orderBy("pos"))
    passages = (
        lines.withColumn("run", run)
        .groupBy("conv_id", "turn", "message", "level", "run")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "unit"))).alias("parts"))
        .select("conv_id", "turn", "message", "level", F.lit(True).alias("whole"), F.array_join("parts.unit", " ").alias("unit"))
    )
    return passages.union(lines.select("conv_id", "turn", "message", "level", F.lit(False), "unit"))


def link_replies(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, reply_to, thread, depth), a row for each distinct (conv_id, turn, role, text).

    reply_to is the earlier turn that a message quotes: of what it quotes at its shallowest linked level, whole passages
    before lines, the latest. thread is the turn at the far end of the replies (its own for one that quotes nothing) and
    depth the number of replies to there. body is the text without quoted lines. Conversations come in range
    partitions sorted by conv_id, thread and turn, so a reply follows what it answers; a long conversation may span
    partitions. Null text is empty; null conv_id or turn link to nothing; other columns are not carried.
    """
    messages = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    # Tells messages of one turn apart.
    messages = messages.withColumn("message", F.sha2(F.to_json(F.struct("role", "text")), 256))
    quoting = messages.where(F.col("text").startswith(">") | F.col("text").contains("\n>"))
    open_ = quoting.where("turn IS NOT NULL").select("conv_id").distinct()
    quoted = units(quoting).where("level > 0").withColumn("hash", F.xxhash64("unit"))
    own = units(messages.join(open_, "conv_id", "left_semi")).where("level = 0").withColumn("hash", F.xxhash64("unit"))
    origins = own.groupBy("conv_id", "hash", "unit").agg(F.min("turn").alias("origin"))
    found = quoted.join(origins, ["conv_id", "hash", "unit"]).where("origin < turn")
    best = F.max(F.struct((-F.col("level")).alias("near"), "whole", "origin"))["origin"]
    links = materialize(found.groupBy("conv_id", "turn", "message").agg(best.alias("reply_to")), "links")

    # From each linked turn to the far end, twice as far each round.
    up = materialize(links.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("thread")).withColumn("depth", F.lit(1).cast("long")), "threads")
    while True:
        on = up.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("far"), F.col("depth").alias("more"))
        on = up.join(on, (F.col("conv_id") == F.col("c")) & (F.col("thread") == F.col("t")), "left")
        if on.where("t IS NOT NULL").isEmpty():
            break
        up = materialize(
            on.select("conv_id", "turn", F.coalesce("far", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "threads"
        )
    out = messages.join(links, ["conv_id", "turn", "message"], "left").join(up, ["conv_id", "turn"], "left")
    out = out.select(
        "conv_id", "turn", "role",
        F.array_join(F.filter(F.split("text", "\n"), lambda line: ~line.startswith(">")), "\n").alias("body"),
        "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
    )
    return out.repartitionByRange("conv_id", "thread", "turn").sortWithinPartitions("conv_id", "thread", "turn")


def quoting(conversations: DataFrame) -> DataFrame:
    """conversations whose later messages quote earlier ones, as mail clients do, made of any conversations.

    Every turn but the first answers the one before it below its first line as a quotation; every third turn quotes the quotation
    in that too, and every fifth the first line of the conversation.
    """
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    line = lambda text: F.element_at(F.split(text, "\n"), 1)
    before, further = line(F.lag("text", 1).over(by_turn)), line(F.lag("text", 2).over(by_turn))
    first = line(F.first("text").over(by_turn))
    quoted = (
        F.when(before.isNull(), "")
        .when(F.col("turn") % 5 == 4, F.concat(F.lit("> "), first, F.lit("\n\n")))
        .when((F.col("turn") % 3 == 2) & further.isNotNull(), F.concat(F.lit(">> "), further, F.lit("\n> "), before, F.lit("\n\n")))
        .otherwise(F.concat(F.lit("> "), before, F.lit("\n")))
    )
    return conversations.withColumn("text", F.concat(quoted, F.coalesce("text", F.lit(""))))


#: The same as quoting, as a table named q.
QUOTING = """
q AS (SELECT conv_id, turn, role, CASE WHEN b IS NULL THEN '' WHEN turn % 5 = 4 THEN '> ' || string_split(f, chr(10))[1] || chr(10) || chr(10)
        WHEN turn % 3 = 2 AND g IS NOT NULL THEN '>> ' || string_split(g, chr(10))[1] || chr(10) || '> ' || string_split(b, chr(10))[1] || chr(10) || chr(10)
        ELSE '> ' || string_split(b, chr(10))[1] || chr(10) END || coalesce(text, '') AS text
      FROM (SELECT *, lag(text, 1) OVER w AS b, lag(text, 2) OVER w AS g, first_value(text) OVER w AS f FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)))"""
#: The same as link_replies, for tables without repeated (conv_id, turn).
ORACLE = r"""
WITH RECURSIVE m AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
split AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM m),
lines AS (
  SELECT conv_id, turn, pos, length(regexp_replace(regexp_extract(line, '^(?:> ?)+'), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(lower(regexp_replace(line, '^(?:> ?)+', '')), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS unit
  FROM split),
runs AS (SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY pos) AS run FROM lines WHERE unit <> ''),
units AS (
  SELECT conv_id, turn, level, true AS whole, string_agg(unit, ' ' ORDER BY pos) AS unit FROM runs GROUP BY conv_id, turn, level, run
  UNION ALL SELECT conv_id, turn, level, false, unit FROM runs),
origins AS (SELECT conv_id, unit, min(turn) AS origin FROM units WHERE level = 0 GROUP BY ALL),
links AS (
  SELECT q.conv_id, q.turn, max({'near': -level, 'whole': whole, 'origin': origin}).origin AS reply_to
  FROM units q JOIN origins o ON q.conv_id = o.conv_id AND q.unit = o.unit AND o.origin < q.turn
  WHERE level > 0 GROUP BY ALL),
up AS (
  SELECT conv_id, turn, reply_to AS far, 1 AS depth FROM links
  UNION ALL SELECT u.conv_id, u.turn, l.reply_to, depth + 1 FROM up u JOIN links l ON l.conv_id = u.conv_id AND l.turn = u.far),
ends AS (SELECT conv_id, turn, min(far) AS thread, max(depth) AS depth FROM up GROUP BY ALL)
SELECT m.conv_id, m.turn, role,
       array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT starts_with(l, '>')), chr(10)) AS body,
       reply_to, coalesce(thread, m.turn) AS thread, coalesce(depth, 0)::BIGINT AS depth
FROM m LEFT JOIN links ON links.conv_id = m.conv_id AND links.turn = m.turn
LEFT JOIN ends ON ends.conv_id = m.conv_id AND ends.turn = m.turn
"""
QUOTING_ORACLE = ORACLE.replace("WITH RECURSIVE m", f"WITH RECURSIVE {QUOTING}, m").replace("AS text FROM conversations),\nsplit", "AS text FROM q),\nsplit")
