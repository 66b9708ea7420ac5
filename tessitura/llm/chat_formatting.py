"""Chat formatting by quotation linking; DataFrame functions only.

A message's lines begin with quote marks (``>``, blanks between them allowed); their number is a line's quote level. A
run of lines of equal level is a passage. A passage at level 0 is the message's own text. A passage at level n >= 1 is
normalised (lower case, runs of anything but letters and digits as one blank, trimmed), hashed, and joined to the
hashes of what earlier messages of the same conversation say: their whole own text, each of their own passages and
each of their own lines. The message that a passage at the lowest quoted level links to is the reply's parent;
deeper passages link to the parents' own sources. A message without such a link replies to the one before it.

The output is a row per message: the text without quotes, the parent turn, whether a quote gave it, the number of
quoted passages and of linked ones, its depth in the reply tree, and its place in reply order (the conversation's
messages walked from each parent to its replies, turns rising). Depth and place come from pointer doubling over the
reply tree's tour, so a thread of n messages takes log2(n) joins.

Cases: null and empty texts are empty messages; unknown quotes are dropped from the text and link to nothing; of
several earlier messages that say the same, the latest is quoted; a quote never links to its own or a later turn;
repeated (conv_id, turn) rows count once, the least text and role being kept; null conv_ids or turns are left out;
quote marks alone make an empty passage, which links to nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise

#: Turns of a range: what one window holds of a conversation at most.
RANGE = 4096


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parse_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own (text without quotes), passages (array of level, text), lines (own lines)."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n")
    marked = F.transform(
        lines,
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, r"^((?:[ \t]*>)*)", 1), r"[^>]", "")).alias("level"),
            F.regexp_replace(line, r"^(?:[ \t]*>)+[ \t]?", "").alias("text"),
        ),
    )
    # runs of lines of one level: a fold over the message's lines
    empty = F.expr("cast(array() as array<struct<level:int,text:string>>)")
    passages = F.aggregate(
        "marked",
        empty,
        lambda done, line: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["level"] == line["level"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(line["level"].alias("level"), F.concat_ws("\n", F.element_at(done, -1)["text"], line["text"]).alias("text")))),
        ).otherwise(F.concat(done, F.array(line))),
    )
    parsed = messages.withColumn("marked", marked)
    # most messages quote nothing: they are one passage, and need no fold
    plain = ~F.exists("marked", lambda line: line["level"] > 0)
    parsed = parsed.withColumn("passages", F.when(plain, F.array(F.struct(F.lit(0).alias("level"), F.array_join(F.transform("marked", lambda line: line["text"]), "\n").alias("text")))).otherwise(passages))
    own = F.filter("passages", lambda p: p["level"] == 0)
    return parsed.select(
        "conv_id",
        "turn",
        "role",
        F.trim(F.regexp_replace(F.array_join(F.transform(own, lambda p: p["text"]), "\n"), r"\n{3,}", "\n\n"), F.lit(" \n\t")).alias("own"),
        "passages",
        F.transform(F.filter("marked", lambda line: line["level"] == 0), lambda line: line["text"]).alias("lines"),
    )


def _hash(text: Column) -> Column:
    """Two 64-bit hashes of the normal form; null where nothing is left of it."""
    n = normalised(text)
    return F.when(n != "", F.struct(F.xxhash64(n).alias("h1"), F.xxhash64(n, F.lit(1)).alias("h2")))


def latest_before(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Add ``name``: the largest ``value`` among the rows of the same keys whose ``order`` is smaller.

    Two levels: inside a range of ``order``, and over the ranges' maxima, so that a key with a third of all rows is
    windowed in parts.
    """
    cut = rows.withColumn("_range", F.floor(F.col(order) / F.lit(RANGE)))
    inside = F.max(value).over(Window.partitionBy(*keys, "_range").orderBy(order).rangeBetween(Window.unboundedPreceding, -1))
    ranges = cut.groupBy(*keys, "_range").agg(F.max(value).alias("_most"))
    ranges = ranges.withColumn("_former", F.max("_most").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).where("_former is not null").drop("_most")
    return cut.withColumn("_inside", inside).join(ranges, [*keys, "_range"], "left").withColumn(name, F.coalesce("_inside", "_former")).drop("_inside", "_former", "_range")


def link_quotes(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, quoted (turn), n_quotes, n_linked: what each quoting message's passages link to."""
    said = F.array_distinct(
        F.concat(F.array(_hash(F.col("own"))), F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: _hash(p["text"])), F.transform("lines", _hash))
    )
    asking = parsed.withColumn("quotes", F.filter("passages", lambda p: p["level"] > 0)).where(F.size("quotes") > 0)
    quotes = asking.select("conv_id", "turn", F.posexplode("quotes").alias("place", "quote")).select("conv_id", "turn", "place", F.col("quote.level").alias("level"), _hash(F.col("quote.text")).alias("h"))
    sources = parsed.join(asking.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", F.explode(said).alias("h"), F.col("turn").alias("source")).where("h is not null")
    both = quotes.withColumn("source", F.lit(None).cast("long")).unionByName(sources.withColumn("place", F.lit(None).cast("int")).withColumn("level", F.lit(None).cast("int")))
    met = latest_before(both, ["conv_id", "h"], "turn", "source", "found").where("place is not null")
    linked = F.col("found").isNotNull() & F.col("h").isNotNull()
    return met.groupBy("conv_id", "turn").agg(
        F.min_by(F.when(linked, F.col("found")), F.when(linked, F.struct("level", "place"))).alias("quoted"),
        F.count(F.lit(1)).alias("n_quotes"),
        F.count(F.when(linked, 1)).alias("n_linked"),
    )


def format_chats(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per message in reply order: conv_id, turn, role, text, parent_turn, linked, n_quotes, n_linked, depth, reply_order."""
    base = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).where("conv_id is not null and turn is not null")
    base = base.groupBy("conv_id", "turn").agg(F.min(F.struct("text", "role")).alias("m")).select("conv_id", "turn", "m.role", "m.text")
    parsed = materialise(parse_quotes(base), "parsed")
    links = link_quotes(parsed)
    # the tree is made of ids alone; texts are joined to it once
    ids = parsed.select("conv_id", "turn", F.col("turn").alias("same")).join(links, ["conv_id", "turn"], "left")
    ids = latest_before(ids, ["conv_id"], "turn", "same", "before")
    zero = F.lit(0).cast("long")
    tree = materialise(
        ids.select("conv_id", "turn", F.coalesce("quoted", "before").alias("parent_turn"), F.col("quoted").isNotNull().alias("linked"), F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked")),
        "replies",
    )
    placed = tree.join(reply_order(tree), ["conv_id", "turn"])
    texts = parsed.select("conv_id", "turn", "role", F.col("own").alias("text"))
    return texts.join(placed, ["conv_id", "turn"]).select("conv_id", "turn", "role", "text", "parent_turn", "linked", "n_quotes", "n_linked", "depth", "reply_order")


def reply_order(rows: DataFrame) -> DataFrame:
    """conv_id, turn, depth, reply_order from parent_turn.

    The tree's tour enters and leaves each message once. A step leans on the step before it: an entry on the leaving of
    the sibling before, or else on the parent's entry; a leaving on the last reply's, or else on its own entry. How many
    messages a step has behind it is found by pointer doubling, a join per round, with constant memory a message.
    """
    tree = rows.select("conv_id", "turn", "parent_turn", F.col("turn").alias("same"))
    last = tree.where("parent_turn is not null").groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.max("turn").alias("reply"))
    tree = latest_before(tree, ["conv_id", "parent_turn"], "turn", "same", "former").join(last, ["conv_id", "turn"], "left")
    sibling = F.when(F.col("parent_turn").isNotNull(), F.col("former"))
    enter = tree.select("conv_id", "turn", F.lit(True).alias("entering"), F.coalesce(sibling, "parent_turn").alias("back"), sibling.isNull().alias("back_entering"), F.lit(1).cast("long").alias("messages"), F.lit(1).cast("long").alias("level"))
    leave = tree.select("conv_id", "turn", F.lit(False).alias("entering"), F.coalesce("reply", "turn").alias("back"), F.col("reply").isNull().alias("back_entering"), F.lit(0).cast("long").alias("messages"), F.lit(-1).cast("long").alias("level"))
    now = materialise(enter.unionByName(leave), "tour")
    while not now.where("back is not null").isEmpty():
        behind = now.select("conv_id", F.col("turn").alias("back"), F.col("entering").alias("back_entering"), F.col("back").alias("then"), F.col("back_entering").alias("then_entering"), F.col("messages").alias("more"), F.col("level").alias("levels"))
        # steps that have reached the beginning only answer; the others move on
        moving = now.where("back is not null").join(behind, ["conv_id", "back", "back_entering"]).select(
            "conv_id", "turn", "entering", F.col("then").alias("back"), F.col("then_entering").alias("back_entering"), (F.col("messages") + F.col("more")).alias("messages"), (F.col("level") + F.col("levels")).alias("level")
        )
        former, now = now, materialise(now.where("back is null").unionByName(moving), "tour")
        discard(former)
    return now.where("entering").select("conv_id", "turn", (F.col("level") - 1).alias("depth"), F.col("messages").alias("reply_order"))


def conversations(formatted: DataFrame) -> DataFrame:
    """conv_id and its messages (role, text) in reply order, for training."""
    return formatted.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("reply_order", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


_NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')"
ORACLE_OP8 = rf"""
with recursive m as (select conv_id, turn, role, text from conversations where conv_id is not null and turn is not null
  qualify row_number() over (partition by conv_id, turn order by text nulls first, role nulls first) = 1),
l as (select conv_id, turn, unnest(s) as line, generate_subscripts(s, 1) as i
  from (select conv_id, turn, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) as s from m)),
k as (select conv_id, turn, i, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)*'), '[^>]', '', 'g')) as level,
  regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') as t from l),
n as (select *, case when level is distinct from lag(level) over (partition by conv_id, turn order by i) then 1 else 0 end as turned from k),
r as (select *, sum(turned) over (partition by conv_id, turn order by i) as run from n),
p as (select conv_id, turn, run, min(level) as level, string_agg(t, chr(10) order by i) as t from r group by conv_id, turn, run),
own as (select conv_id, turn, trim(regexp_replace(coalesce(string_agg(t, chr(10) order by run) filter (where level = 0), ''), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) as text
  from p group by conv_id, turn),
said as (select distinct conv_id, turn, h from (select conv_id, turn, {_NORM.format("text")} as h from own union all select conv_id, turn, {_NORM.format("t")} from p where level = 0
  union all select conv_id, turn, {_NORM.format("t")} from k where level = 0) where h <> ''),
q as (select conv_id, turn, level, run, {_NORM.format("t")} as h from p where level > 0),
s as (select q.conv_id, q.turn, q.level, q.run, max(said.turn) as source
  from q left join said on said.conv_id = q.conv_id and said.h = q.h and said.turn < q.turn group by q.conv_id, q.turn, q.level, q.run),
g as (select conv_id, turn, arg_min(source, level * 1000000 + run) filter (where source is not null) as quoted, count(*) as n_quotes, count(source) as n_linked from s group by conv_id, turn),
t as (select m.conv_id, m.turn, m.role, coalesce(quoted, lag(m.turn) over (partition by m.conv_id order by m.turn)) as parent_turn, quoted is not null as linked,
  coalesce(n_quotes, 0) as n_quotes, coalesce(n_linked, 0) as n_linked from m left join g on g.conv_id = m.conv_id and g.turn = m.turn),
w(conv_id, turn, depth, path) as (select conv_id, turn, cast(0 as bigint), [turn] from t where parent_turn is null
  union all select t.conv_id, t.turn, w.depth + 1, list_append(w.path, t.turn) from t join w on w.conv_id = t.conv_id and w.turn = t.parent_turn)
select t.conv_id, t.turn, t.role, own.text, t.parent_turn, t.linked, t.n_quotes, t.n_linked, w.depth,
  row_number() over (partition by t.conv_id order by w.path) as reply_order
from t join own on own.conv_id = t.conv_id and own.turn = t.turn join w on w.conv_id = t.conv_id and w.turn = t.turn
"""


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
