"""Chat formatting by quotation linking, in DataFrame functions only.

A line's quote level is the number of '>' that it begins with (a blank may stand before each). A passage is
a run of lines of one level without a blank line between. Passages, and their single lines and sentences (up to
a ., ! or ? before a blank) for those that quote a part, re-wrapped or not, are normalised (A-Z lower-cased,
white space and line ends run to one blank, trimmed) and hashed; within a conversation, each is joined to its
original: the latest message before that holds it unquoted. The message that most of a
message's level-one passages, lines and sentences come from (the later one of equals) is its parent; deeper levels are linked and counted likewise. Following parents by
pointer doubling gives each message its thread and depth, and (conv_id, thread, depth, turn) orders a
conversation by replies. The body is the message without quoted lines and without an "On ... wrote:" line that
stands before one, a blank line between them or not.

Originals are found by running maxima over ranges of (passage, turn), so a passage that is repeated without end, or a
conversation that holds a third of all messages, is no group of one task, and no passage meets all its holders.

Defined cases: null text is an empty message; blank quoted lines are counted in no level; a null conv_id
or turn links with nothing; repeated rows give a row each and are one message for linking; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table
from .scan import ranged, running

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = r"^(?:[ \t]?>)+"
WROTE = r"^[Oo]n .+ wrote:[ \t]*$"


def _norm(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, _UPPER, _LOWER), r"[ \t\r\f]+", " "))


def _level(line: Column) -> Column:
    return F.length(F.translate(F.regexp_extract(line, PREFIX, 0), " \t", ""))


def _lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n")


def parsed(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, n_quoted (distinct quoted lines), max_level."""
    lines = _lines()
    has = F.exists(lines, lambda x: x.rlike(PREFIX))
    at = lambda i: F.coalesce(F.get(lines, i), F.lit(""))
    before = lambda i: at(i + 1).rlike(PREFIX) | (at(i + 1).rlike(r"^[ \t\r]*$") & at(i + 2).rlike(PREFIX))
    body = F.when(has, F.filter(lines, lambda x, i: ~x.rlike(PREFIX) & ~(x.rlike(WROTE) & before(i)))).otherwise(lines)
    told = F.transform(F.filter(lines, lambda x: x.rlike(PREFIX)), lambda x: F.struct(_level(x).alias("level"), _norm(F.regexp_replace(x, PREFIX, "")).alias("line")))
    quoted = F.when(has, F.array_distinct(F.filter(told, lambda q: q["line"] != "")))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.trim(F.array_join(body, "\n"), F.lit("\n")).alias("body"),
        F.coalesce(F.size(quoted), F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce(F.array_max(F.transform(quoted, lambda q: q["level"])), F.lit(0)).cast("long").alias("max_level"),
    )


def passages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, level, h, g: hashes of the distinct passages, lines and sentences (level 0: unquoted) of all messages."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.posexplode(_lines()).alias("n", "line"))
    lines = rows.select("conv_id", "turn", "n", _level(F.col("line")).alias("level"), _norm(F.regexp_replace("line", PREFIX, "")).alias("norm")).distinct()
    order = Window.partitionBy("conv_id", "turn").orderBy("n", "level", "norm")  # the lines of one message
    before, last = F.lag("level").over(order), F.lag("norm").over(order)
    runs = lines.withColumn("start", (before.isNull() | (before != F.col("level")) | (F.col("norm") == "") | (last == "")).cast("int"))
    runs = runs.withColumn("run", F.sum("start").over(order)).where("norm <> ''")
    whole = runs.groupBy("conv_id", "turn", "run", "level").agg(F.sort_array(F.collect_list(F.struct("n", "norm"))).alias("p"))
    whole = whole.select("conv_id", "turn", "level", F.array_join(F.transform("p", lambda x: x["norm"]), " ").alias("t"))
    sentences = whole.select("conv_id", "turn", "level", F.explode(F.split(F.regexp_replace("t", "([.!?]) ", "$1\n"), "\n")).alias("t"))
    texts = runs.select("conv_id", "turn", "level", F.col("norm").alias("t")).union(whole).union(sentences)
    return texts.select("conv_id", "turn", "level", F.xxhash64("t").alias("h"), F.hash("t").alias("g")).distinct()


def links(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, level, origin, passages: how many distinct quoted passages, lines and sentences come from a message.
    Conversations without quotes are left out at once."""
    quoting = conversations.where(F.exists(_lines(), lambda x: x.rlike(PREFIX))).select("conv_id").distinct()
    every = staged(passages(conversations.join(quoting, "conv_id", "left_semi")), "passages")
    who = F.struct("conv_id", "h", "g").alias("who")
    asked = every.where("level > 0 and turn is not null").select(who, "turn", "level", F.lit(None).cast("long").alias("held"))
    holders = every.where("level = 0 and turn is not null").select(who, "turn", F.lit(-1).cast("long").alias("level"), F.col("turn").alias("held"))
    holders = holders.join(asked.select("who").distinct(), "who", "left_semi")
    # In a turn, those who ask come before those who hold.
    rows = staged(asked.unionByName(holders).withColumn("last", (F.col("level") < 0).cast("int")), "held")
    found = running(ranged(rows, ["who", "turn", "last"], "holders"), "who", ["turn", "last"], ["held"], F.max)
    found = found.where("level > 0 and total_held is not null").select("who.conv_id", "turn", "level", F.col("total_held").alias("origin"))
    return found.groupBy("conv_id", "turn", "level", "origin").agg(F.count(F.lit(1)).alias("passages"))


def threads(parents: DataFrame) -> DataFrame:
    """conv_id, turn, thread, depth from conv_id, turn, parent: pointers double until none moves."""
    now = staged(parents.select("conv_id", "turn", F.col("parent").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        above = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("up"), F.col("depth").alias("more"))
        step = now.join(above, ["conv_id", "thread"], "left")
        after = staged(step.select("conv_id", "turn", F.coalesce("up", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up").isNotNull().alias("moved")), "threads")
        moved = after.where("moved").limit(1).count()
        now = after.drop("moved")
        if not moved:
            return now


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, n_quoted, max_level, n_linked, parent_turn, thread, depth."""
    found = staged(links(conversations), "links")
    best = found.where("level = 1").groupBy("conv_id", "turn").agg(F.max(F.struct("passages", "origin")).alias("b")).select("conv_id", "turn", F.col("b.origin").alias("parent"))
    counted = found.groupBy("conv_id", "turn").agg(F.sum("passages").alias("n_linked"))
    placed = counted.join(threads(best), ["conv_id", "turn"], "left").join(best, ["conv_id", "turn"], "left")
    return parsed(conversations).join(placed, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "body", "n_quoted", "max_level",
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.col("parent").alias("parent_turn"),
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
    )


def in_order(messages: DataFrame) -> DataFrame:
    """Conversations one after the other, each by replies; long ones are split over tasks."""
    return messages.orderBy("conv_id", "thread", "depth", "turn")


def op9_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_order(reply_ordered(table(spark, sf_dir, "conversations")))


OP9_SQL = r"""
with recursive m as (
  select conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) as lines from conversations
), l as (
  select conv_id, turn, unnest(lines) as line, generate_subscripts(lines, 1) as i from m
), n as (
  select conv_id, turn, i, regexp_extract(line, '^([ \t]?>)+') as prefix,
    trim(regexp_replace(translate(regexp_replace(line, '^([ \t]?>)+', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\f]+', ' ', 'g')) as norm
  from l
), v as (
  select distinct conv_id, turn, i, length(prefix) - length(replace(prefix, '>', '')) as level, norm from n
), s as (
  select *, case when lag(level) over w is null or lag(level) over w <> level or norm = '' or lag(norm) over w = '' then 1 else 0 end as start
  from v window w as (partition by conv_id, turn order by i, level, norm)
), r0 as (
  select *, sum(start) over (partition by conv_id, turn order by i, level, norm rows unbounded preceding) as run from s
), q as (
  select distinct conv_id, turn, level, norm from v where level > 0 and norm <> ''
), b as (
  select conv_id, turn, level, string_agg(norm, ' ' order by i, norm) as t from r0 where norm <> '' group by conv_id, turn, run, level
), u as (
  select conv_id, turn, level, norm from r0 where norm <> '' union select * from b union
  select conv_id, turn, level, unnest(string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) from b
), o as (
  select u.conv_id, u.turn, u.level, u.norm, max(o.turn) as origin from u join u o on o.conv_id = u.conv_id and o.norm = u.norm and o.level = 0 and o.turn < u.turn where u.level > 0 group by all
), k as (
  select conv_id, turn, level, origin, count(*) as lines from o group by all
), p as (
  select conv_id, turn, arg_max(origin, lines * 1000000 + origin) as parent from k where level = 1 group by all
), t as (
  select conv_id, turn, parent as thread, 1 as depth from p
  union all
  select t.conv_id, t.turn, p.parent, t.depth + 1 from t join p on p.conv_id = t.conv_id and p.turn = t.thread
), r as (
  select conv_id, turn, arg_max(thread, depth) as thread, max(depth) as depth from t group by all
)
select m.conv_id, m.turn, m.role,
  trim(array_to_string(list_filter(m.lines, lambda x, i: not regexp_matches(x, '^([ \t]?>)+')
    and not (regexp_matches(x, '^[Oo]n .+ wrote:[ \t]*$') and (regexp_matches(coalesce(m.lines[i + 1], ''), '^([ \t]?>)+')
      or (regexp_matches(coalesce(m.lines[i + 1], ''), '^[ \t\r]*$') and regexp_matches(coalesce(m.lines[i + 2], ''), '^([ \t]?>)+'))))), chr(10)), chr(10)) as body,
  coalesce((select count(*) from q where q.conv_id = m.conv_id and q.turn = m.turn), 0)::bigint as n_quoted,
  coalesce((select max(level) from q where q.conv_id = m.conv_id and q.turn = m.turn), 0)::bigint as max_level,
  coalesce((select sum(lines) from k where k.conv_id = m.conv_id and k.turn = m.turn), 0)::bigint as n_linked,
  p.parent as parent_turn, coalesce(r.thread, m.turn) as thread, coalesce(r.depth, 0)::bigint as depth
from m left join p on p.conv_id = m.conv_id and p.turn = m.turn left join r on r.conv_id = m.conv_id and r.turn = m.turn
"""
