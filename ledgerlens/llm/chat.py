"""Reply-ordered conversations by quotation linking (operator 3).

A message's lines have a quote level: the number of ``>`` marks before them.
Runs of lines of one level, cut at blank lines, are passages; each passage and
each of its lines is normalised and hashed.  The original of a quoted text is
the first message of its conversation that wrote it as its own.  A message
replies to the earlier message whose words its outermost quotes match most,
else to the last earlier turn there is.  Only DataFrame functions run; the links are
equi-joins on (conversation, hash) with one original per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import written

_PREFIX = r"^\s?(?:>\s?)+"
_ATTRIBUTION = r"^(On|Am|Le|El)\b.*(wrote|schrieb.*|écrit|escribió)\s?:$"
#: Turns whose message is looked for together when a message follows the one before.
TURN_BLOCK = 1024


def _parsed(text: Column) -> Column:
    """Lines as (level, body): body without quote marks."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\r?\n"),
        lambda x: F.struct(
            F.length(F.translate(F.regexp_extract(x, _PREFIX, 0), " \t", "")).alias("level"),
            F.regexp_replace(x, _PREFIX, "").alias("body"),
        ),
    )


def _normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _passages() -> Column:
    """Passages of the parsed lines as (level, text), line feeds inside: runs of lines of
    one level, cut at blank lines."""
    lines = F.col("lines")

    def level(i: Column) -> Column:
        """The line's level, or NULL if it is blank or there is none."""
        line = F.get(lines, i)
        return F.when(F.trim(line["body"]) != "", line["level"])

    places = F.sequence(F.lit(0), F.size(lines) - 1)
    starts = F.filter(places, lambda i: level(i).isNotNull() & ~level(i).eqNullSafe(level(i - 1)))
    ends = F.filter(places, lambda i: level(i).isNotNull() & ~level(i).eqNullSafe(level(i + 1)))
    return F.zip_with(
        starts,
        ends,
        lambda a, b: F.struct(
            level(a).alias("level"),
            F.array_join(F.transform(F.slice(lines, a + 1, b - a + 1), lambda x: x["body"]), "\n").alias("text"),
        ),
    )


def _own(lines: str) -> Column:
    """The message without quotes, the lines that announce them, and outer blank lines."""
    kept = F.filter(
        lines,
        lambda x, i: (x["level"] == 0)
        & ~(F.trim(x["body"]).rlike(_ATTRIBUTION) & F.coalesce(F.get(lines, i + 1)["level"] > 0, F.lit(False))),
    )
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")


def link_quotations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> one row per input row: conv_id, turn,
    role, content, n_quoted, n_linked, parent_turn, root_turn, depth, chat.

    ``content`` is the message without quotes; ``n_quoted`` counts its quoted
    passages, ``n_linked`` those whose original was found; ``parent_turn`` is
    the message replied to (NULL for a first message), ``root_turn`` and
    ``depth`` its place in the reply tree; ``chat`` is the formatted message.
    Sorted by (conv_id, root_turn, turn) messages follow what they reply to.

    NULL texts are empty messages; a NULL role is "unknown".  A NULL conv_id
    or turn links with nothing and is its own root.  Rows that repeat a
    (conv_id, turn) are one message with several rows.  Extra columns are
    ignored; an empty table gives no rows.
    """
    base = messages.select("conv_id", "turn", "role", _parsed(F.col("text")).alias("lines"))
    base = base.select("conv_id", "turn", "role", "lines", _passages().alias("passages"))
    parsed = written(base.select("conv_id", "turn", "role", _own("lines").alias("content"), "passages"), "messages")

    units = parsed.where("conv_id is not null and turn is not null").select(
        "conv_id", "turn", F.posexplode("passages").alias("passage", "p")
    )
    texts = F.array_distinct(
        F.filter(
            F.concat(F.array(_normalised(F.col("p.text"))), F.transform(F.split("p.text", "\n"), _normalised)),
            lambda t: t != "",
        )
    )
    units = units.select("conv_id", "turn", "passage", "p.level", F.explode(texts).alias("t")).select(
        "conv_id", "turn", "passage", "level", F.xxhash64("t").alias("hash"), F.length("t").alias("size")
    )
    units = written(units, "passages")
    originals = units.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    linked = written(
        units.where("level > 0").join(originals, ["conv_id", "hash"]).where("original < turn").drop("hash"), "quotes"
    )
    votes = linked.groupBy("conv_id", "turn", "level", "original").agg(F.sum("size").alias("votes"))
    chosen = votes.groupBy("conv_id", "turn").agg(
        F.max_by("original", F.struct(-F.col("level"), F.col("votes"), F.col("original"))).alias("quoted")
    )
    found = linked.groupBy("conv_id", "turn").agg(F.count_distinct("passage").alias("n_linked"))

    nodes = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    tree = written(
        _with_last(nodes)
        .join(chosen, ["conv_id", "turn"], "left")
        .select("conv_id", "turn", F.coalesce("quoted", "last").alias("parent")),
        "tree",
    )
    places = _places(tree)
    joined = (
        parsed.join(tree, ["conv_id", "turn"], "left")
        .join(places, ["conv_id", "turn"], "left")
        .join(found, ["conv_id", "turn"], "left")
    )
    role = F.coalesce("role", F.lit("unknown"))
    return joined.select(
        "conv_id",
        "turn",
        role.alias("role"),
        "content",
        F.size(F.filter("passages", lambda p: p["level"] > 0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("parent").alias("parent_turn"),
        F.coalesce("root", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.concat(F.lit("<|"), role, F.lit("|>\n"), "content", F.lit("\n<|end|>\n")).alias("chat"),
    )


def _with_last(nodes: DataFrame) -> DataFrame:
    """Distinct (conv_id, turn) with ``last``, the greatest smaller turn of the conversation.
    Windows run over blocks of TURN_BLOCK turns, and over one row per block for the
    first message of each, so a conversation of any length is split."""
    block = F.floor(F.col("turn") / TURN_BLOCK)
    nodes = nodes.withColumn("block", block)
    within = Window.partitionBy("conv_id", "block").orderBy("turn")
    across = Window.partitionBy("conv_id").orderBy("block")
    ends = nodes.groupBy("conv_id", "block").agg(F.max("turn").alias("end"))
    ends = ends.select("conv_id", "block", F.lag("end").over(across).alias("before"))
    placed = nodes.withColumn("near", F.lag("turn").over(within)).join(ends, ["conv_id", "block"])
    return placed.select("conv_id", "turn", F.coalesce("near", "before").alias("last"))


def _places(tree: DataFrame) -> DataFrame:
    """(conv_id, turn, parent) -> (conv_id, turn, root, depth) by pointer doubling:
    every round doubles how far up a message looks, and messages that see a
    first message take no further part."""
    at = tree.select(
        "conv_id",
        "turn",
        F.coalesce("parent", "turn").alias("root"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        F.col("parent").isNotNull().alias("open"),
    )
    while True:
        at = written(at, "places")
        if at.where("open").isEmpty():
            return at.drop("open")
        up = at.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        moved = (
            at.where("open")
            .join(up, ["conv_id", "root"])
            .select(
                "conv_id",
                "turn",
                F.col("next").alias("root"),
                (F.col("depth") + F.col("more")).alias("depth"),
                (F.col("next") != F.col("root")).alias("open"),
            )
        )
        at = at.where("not open").union(moved)


def in_reply_order(linked: DataFrame) -> DataFrame:
    """Messages sorted so that each conversation's replies follow their originals."""
    return linked.orderBy("conv_id", "root_turn", "turn")


ORACLE = r"""
WITH RECURSIVE src AS MATERIALIZED (
  SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, 'unknown') AS role,
    string_split_regex(coalesce(text, ''), '\r?\n') AS l FROM conversations
),
cut AS (SELECT r, conv_id, turn, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM src),
lines AS MATERIALIZED (
  SELECT r, conv_id, turn, i,
    length(replace(replace(regexp_extract(line, '^[\t-\r ]?(?:>[\t-\r ]?)+'), ' ', ''), chr(9), '')) AS level,
    regexp_replace(line, '^[\t-\r ]?(?:>[\t-\r ]?)+', '') AS body FROM cut
),
own AS (
  SELECT r, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT (announces AND coalesce(next > 0, false))), ''),
    '^[\t-\r ]+|[\t-\r ]+$', '', 'g') AS content
  FROM (SELECT *, lead(level) OVER (PARTITION BY r ORDER BY i) AS next,
    regexp_matches(trim(body, ' '), '^(On|Am|Le|El)\b.*(wrote|schrieb.*|écrit|escribió)[\t-\r ]?:$') AS announces FROM lines) GROUP BY r
),
marked AS (
  SELECT *, CASE WHEN shown IS NOT NULL AND shown IS DISTINCT FROM lag(shown) OVER (PARTITION BY r ORDER BY i) THEN 1 ELSE 0 END AS starts
  FROM (SELECT *, CASE WHEN trim(body, ' ') <> '' THEN level END AS shown FROM lines)
),
passages AS MATERIALIZED (
  SELECT r, conv_id, turn, passage, any_value(level) AS level, list(body ORDER BY i) AS bodies
  FROM (SELECT *, sum(starts) OVER (PARTITION BY r ORDER BY i) AS passage FROM marked) WHERE shown IS NOT NULL
  GROUP BY r, conv_id, turn, passage
),
units AS MATERIALIZED (
  SELECT DISTINCT r, conv_id, turn, passage, level, t FROM (
    SELECT r, conv_id, turn, passage, level, trim(regexp_replace(lower(x), '[\t-\r ]+', ' ', 'g'), ' ') AS t FROM (
      SELECT *, unnest(list_append(bodies, array_to_string(bodies, chr(10)))) AS x FROM passages
      WHERE conv_id IS NOT NULL AND turn IS NOT NULL)) WHERE t <> ''
),
originals AS (SELECT conv_id, t, min(turn) AS original FROM units WHERE level = 0 GROUP BY ALL),
linked AS MATERIALIZED (
  SELECT u.*, o.original FROM units u JOIN originals o ON u.conv_id = o.conv_id AND u.t = o.t WHERE u.level > 0 AND o.original < u.turn
),
found AS (SELECT conv_id, turn, count(DISTINCT passage) AS n_linked FROM linked GROUP BY ALL),
chosen AS (
  SELECT conv_id, turn, arg_max(original, (-level, votes, original)) AS quoted FROM (
    SELECT conv_id, turn, level, original, sum(length(t)) AS votes FROM linked GROUP BY ALL) GROUP BY ALL
),
quoted AS (SELECT r, count(*) FILTER (WHERE level > 0) AS n_quoted FROM passages GROUP BY r),
nodes AS (SELECT DISTINCT conv_id, turn FROM src WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
tree AS MATERIALIZED (
  SELECT n.conv_id, n.turn, coalesce(c.quoted, n.last) AS parent
  FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM nodes) n
  LEFT JOIN chosen c ON n.conv_id = c.conv_id AND n.turn = c.turn
),
places AS (
  SELECT conv_id, turn, turn AS root, 0 AS depth FROM tree WHERE parent IS NULL
  UNION ALL
  SELECT t.conv_id, t.turn, p.root, p.depth + 1 FROM places p JOIN tree t ON t.conv_id = p.conv_id AND t.parent = p.turn
)
SELECT m.conv_id, m.turn, m.role, o.content, CAST(coalesce(q.n_quoted, 0) AS BIGINT) AS n_quoted, CAST(coalesce(f.n_linked, 0) AS BIGINT) AS n_linked,
       t.parent AS parent_turn, coalesce(p.root, m.turn) AS root_turn, CAST(coalesce(p.depth, 0) AS BIGINT) AS depth,
       '<|' || m.role || '|>' || chr(10) || o.content || chr(10) || '<|end|>' || chr(10) AS chat
FROM src m JOIN own o USING (r) LEFT JOIN quoted q USING (r)
LEFT JOIN found f ON f.conv_id = m.conv_id AND f.turn = m.turn
LEFT JOIN tree t ON t.conv_id = m.conv_id AND t.turn = m.turn
LEFT JOIN places p ON p.conv_id = m.conv_id AND p.turn = m.turn
"""
