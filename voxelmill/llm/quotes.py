"""Quotation linking: who replied to which message, and what is left without quotes.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.llm.common import cut, materialise

MARKS = r"^((?:[ \t]{0,3}>)+)"
#: A line that announces a quote ("... wrote:"), in the corpus' four languages.
LEAD_IN = r"(?i)^.{0,200}\b(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"


def quoted_lines(text: Column) -> Column:
    """``array<struct<depth int, body string>>``: each line's count of quote marks and the line without them."""
    return F.transform(
        F.split(text, "\n", -1),
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("depth"),
            F.regexp_replace(x, MARKS + r"[ \t]?", "").alias("body"),
        ),
    )


def normalised(body: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(body, r"\s+", " ")))


def link_quotes(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, turn, role, text)`` to messages without quotes, linked to what they quote.

    Returns conv_id, turn, role, text (own lines only, without lead-in lines
    before a quote), n_quoted (quoted lines with text), max_depth, n_linked
    (those found in an earlier message of the conversation), reply_to (the turn
    that most lines of the least linked depth come from; the latest on a tie) and
    branch_turn (the first message of its chain of replies).  ``(branch_turn,
    turn)`` orders a conversation by replies: each after what it answers.

    A passage is a run of quoted lines of one depth.  Its lines, and its pairs of
    adjacent lines, are compared in lower case with single spaces by their hashes
    to all earlier messages; its original has most of its lines, then most of its
    pairs, and is the latest such message.  Null text is empty; rows with a null
    conv_id or turn get no link; repeated rows stay; an empty table gives none;
    other columns are ignored.
    """
    rows = messages.select("conv_id", "turn", "role", quoted_lines(F.coalesce("text", F.lit(""))).alias("lines"))
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    own = F.filter(
        F.transform("lines", lambda x, i: F.struct(x["depth"].alias("depth"), x["body"].alias("body"), F.coalesce(F.get("lines", i + 1)["depth"], F.lit(0)).alias("next"))),
        lambda x: (x["depth"] == 0) & ~((x["next"] > 0) & x["body"].rlike(LEAD_IN)),
    )
    marked = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), x["depth"].alias("depth"), normalised(x["body"]).alias("body"))), lambda x: x["depth"] > 0)
    rows = rows.select("conv_id", "turn", "role", "_id", F.transform(own, lambda x: x["body"]).alias("own"), marked.alias("marked"))
    rows = materialise(rows.withColumn("quoted", F.filter("marked", lambda x: x["body"] != "")))

    # k = 0: a line, 1: two adjacent lines
    said = rows.where("conv_id is not null and turn is not null")
    said = said.select("conv_id", "turn", F.transform(F.filter(F.transform("own", normalised), lambda x: x != ""), lambda x: F.xxhash64(x)).alias("hs"))
    pair = F.transform("hs", lambda x, i: F.struct(F.lit(1).alias("k"), F.when(F.get("hs", i + 1).isNotNull(), F.xxhash64(x, F.get("hs", i + 1))).alias("h")))
    said = said.select("conv_id", F.col("turn").alias("origin"), F.explode(F.concat(F.transform("hs", lambda x: F.struct(F.lit(0).alias("k"), x.alias("h"))), pair)).alias("x"))
    said = said.select("conv_id", "origin", "x.k", "x.h").where("h is not null").distinct()
    line = Window.partitionBy("_id").orderBy("i")
    cited = rows.where("size(quoted) > 0").select("_id", "conv_id", "turn", F.explode("marked").alias("q")).select("_id", "conv_id", "turn", "q.*")
    goes_on = (F.lag("depth").over(line) == F.col("depth")) & (F.lag("i").over(line) == F.col("i") - 1)
    cited = cited.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("new").over(line)).where("body <> ''").withColumn("h", F.xxhash64("body"))
    cited = cited.withColumn("next", F.lead("h").over(Window.partitionBy("_id", "run").orderBy("i")))
    both = F.array(F.struct(F.lit(0).alias("k"), F.col("h")), F.struct(F.lit(1).alias("k"), F.when(F.col("next").isNotNull(), F.xxhash64("h", "next")).alias("h")))
    cited = cited.select("_id", "conv_id", "turn", "depth", "run", "i", F.explode(both).alias("x")).select("_id", "conv_id", "turn", "depth", "run", "i", "x.k", "x.h")
    found = materialise(cited.join(said, ["conv_id", "k", "h"]).where("origin < turn").select("_id", "conv_id", "turn", "depth", "run", "i", "k", "origin"))
    votes = found.groupBy("_id", "conv_id", "turn", "depth", "run", "origin").agg(F.sum(1 - F.col("k")).alias("n"), F.sum("k").alias("pairs"))
    votes = votes.groupBy("_id", "conv_id", "turn", "depth", "run").agg(F.max(F.struct("n", "pairs", "origin")).alias("o"))
    votes = votes.groupBy("_id", "conv_id", "turn", "depth", F.col("o.origin").alias("origin")).agg(F.sum("o.n").alias("n"))
    best = F.max(F.struct((-F.col("depth")).alias("d"), F.col("n"), F.col("origin"))).alias("best")
    links = votes.groupBy("_id", "conv_id", "turn").agg(best).select("_id", "conv_id", "turn", F.col("best.origin").alias("reply_to"))
    links = materialise(links.join(found.where("k = 0").groupBy("_id").agg(F.countDistinct("i").alias("n_linked")), "_id"))

    # follow chains of replies, twice as far each time
    up = links.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("top"))
    while True:
        above = up.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("_top"))
        nxt = up.join(above, ["conv_id", "top"], "left")
        up = cut(nxt.select("conv_id", "turn", F.coalesce("_top", "top").alias("top"), F.col("_top").isNotNull().alias("_moved")))
        moved = up.where("_moved").limit(1).count()
        up = up.drop("_moved")
        if not moved:
            break
    out = rows.join(links.select("_id", "reply_to", "n_linked"), "_id", "left").join(up, ["conv_id", "turn"], "left")
    depth = F.array_max(F.transform("quoted", lambda q: q["depth"]))
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.regexp_replace(F.array_join("own", "\n"), r"^\s+|\s+$", "").alias("text"),
        F.size("quoted").cast("long").alias("n_quoted"),
        F.coalesce(depth, F.lit(0)).cast("long").alias("max_depth"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_to",
        F.coalesce("top", "turn").alias("branch_turn"),
    )


#: In DuckDB, with the first message that has a quoted line as its only candidate: the same where own lines do not repeat.
ORACLE_SQL = r"""
WITH RECURSIVE src AS (
  SELECT row_number() OVER () AS id, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations
), lines AS (
  SELECT id, conv_id, turn, i, length(regexp_replace(regexp_extract(l, '^((?:[ \t]{0,3}>)+)', 1), '[^>]', '', 'g')) AS depth,
         regexp_replace(l, '^((?:[ \t]{0,3}>)+)[ \t]?', '') AS body
  FROM (SELECT id, conv_id, turn, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM src)
), marked AS (
  SELECT *, coalesce(lead(depth) OVER (PARTITION BY id ORDER BY i), 0) AS nxt, trim(lower(regexp_replace(body, '\s+', ' ', 'g'))) AS norm FROM lines
), own AS (
  SELECT * FROM marked WHERE depth = 0 AND NOT (nxt > 0 AND regexp_matches(body, '(?i)^.{0,200}\b(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$'))
), cited AS (SELECT * FROM marked WHERE depth > 0 AND norm <> ''),
said AS (SELECT conv_id, norm, min(turn) AS origin FROM own WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
votes AS (SELECT c.id, c.conv_id, c.turn, c.depth, s.origin, count(*) AS n FROM cited c JOIN said s ON c.conv_id = s.conv_id AND c.norm = s.norm AND s.origin < c.turn GROUP BY ALL),
links AS (
  SELECT id, conv_id, turn, origin AS reply_to, total AS n_linked
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth, n DESC, origin DESC) AS r, sum(n) OVER (PARTITION BY id) AS total FROM votes) WHERE r = 1
), parents AS (SELECT conv_id, turn, min(reply_to) AS up FROM links GROUP BY 1, 2),
chain AS (
  SELECT conv_id, turn, up FROM parents
  UNION ALL
  SELECT c.conv_id, c.turn, p.up FROM chain c JOIN parents p ON c.conv_id = p.conv_id AND c.up = p.turn
), tops AS (SELECT conv_id, turn, min(up) AS top FROM chain GROUP BY 1, 2)
SELECT s.conv_id, s.turn, s.role,
       regexp_replace(coalesce((SELECT string_agg(body, chr(10) ORDER BY i) FROM own o WHERE o.id = s.id), ''), '^\s+|\s+$', '', 'g') AS text,
       coalesce((SELECT count(*) FROM cited c WHERE c.id = s.id), 0)::BIGINT AS n_quoted,
       coalesce((SELECT max(depth) FROM cited c WHERE c.id = s.id), 0)::BIGINT AS max_depth,
       coalesce(l.n_linked, 0)::BIGINT AS n_linked, l.reply_to, coalesce(t.top, s.turn) AS branch_turn
FROM src s LEFT JOIN links l ON l.id = s.id LEFT JOIN tops t ON t.conv_id = s.conv_id AND t.turn = s.turn
"""
