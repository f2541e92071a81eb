"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

The non-blank lines of all documents form one sequence of line ids, with a break after each document.
Suffixes are ranked by their first 1, 2, 4, .. lines: the rank of 2h lines is the place, in sorted order, of
the pair (rank of the first h lines, rank of the h lines after them). Suffixes that share a rank at depth h
are an interval of the suffix array with a common prefix of h lines or more; those alone in theirs drop out,
so what is sorted shrinks to what repeats, and doubling ends when nothing does. Classes are counted before
they are sorted, one row each, so that a line in a third of all rows is one row too; the few largest classes
meet their suffixes by broadcast.

The intervals between two depths are found by halving: an interval known to share d lines, and none of whose
parts share d + 2s, is split by the ranks of the s lines after the first d. A part of two suffixes or more is
an interval at d + s; of each part the first member alone goes on to what shares d, as it stands for the others.
At the end every interval has its exact longest common prefix, and every suffix but its first member has its
longest earlier copy: that prefix. A suffix whose copy ends beyond all copies before it begins a maximal run.

A repeated run counts from `min_lines` lines, or fewer with `min_words` words; of every run the first copy by
(doc_id, text, line) stays, and the lines of all later ones are deleted.

Defined results: a null text counts as empty, has no lines and comes back as it was. Blank lines stay and
don't break a run. Rows that agree in id and text are one document each time: neither is later than the
other; rows of one id with other texts are documents of their own, in the order of a hash of the text. Rows
with a null id come back unchanged and delete nothing. Very long texts count whole: one document's lines are
one task's. An empty table gives an empty result. Further columns, whatever their names, pass through, but for
n_lines and n_deleted, which are replaced. Lines are told apart by 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import saved, shuffle_partitions, table

#: Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"
AT = ["doc", "of", "at"]


def line_sequence(docs: DataFrame, key: str = "doc_id", text: str = "text", ahead: int = 3) -> DataFrame:
    """(doc, of, at, line, id, id2, words): place among the document's non-blank lines, and among all its lines;
    words of this line and those after it, `ahead` in all."""
    numbered = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("s")))
    full = F.transform(F.filter(numbered, lambda x: F.length(F.trim(x["s"])) > 0), lambda x: F.struct(x["line"].alias("line"), F.xxhash64(x["s"]).alias("id"), F.xxhash64(F.lit(1), x["s"]).alias("id2"), F.regexp_count(x["s"], F.lit(WORD)).alias("words")))
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(key).alias("doc"), F.xxhash64(text).alias("of"), full.alias("full"))
    after = lambda i: F.transform(F.slice("full", i + 1, ahead), lambda x: x["words"])
    rows = rows.select("doc", "of", F.posexplode(F.transform("full", lambda x, i: F.struct(x["line"].alias("line"), x["id"].alias("id"), x["id2"].alias("id2"), after(i).alias("words")))).alias("at", "x"))
    return rows.select(*AT, "x.*")


def ranked(classes: DataFrame, keys: list[str]) -> DataFrame:
    """classes with `rank`: each one's place in the order of its keys. Keys are distinct."""
    import pyarrow as pa

    spark = classes.sparkSession
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)

    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(range(n, n + b.num_rows), pa.int64())], names=[*b.schema.names, "part", "place"])
            n += b.num_rows

    parts = saved(classes.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(run, f"{schema}, part int, place long"), "ranks")
    sizes = sorted((r["part"], r["n"]) for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a partition
    start, before = [], 0
    for part, n in sizes:
        start.append((part, before))
        before += n
    start = F.broadcast(spark.createDataFrame(start, "part int, before long"))  # one row a partition
    return parts.join(start, "part").select(*classes.columns, (F.col("place") + F.col("before")).alias("rank"))


def intervals(rows: DataFrame, keys: list[str], heavy: int = 1000) -> DataFrame | None:
    """rows of classes with two members or more, with the class's rank and first member; None if there are none.

    A class with more than one in `heavy` of all these rows is joined by broadcast: there are fewer than `heavy`."""
    classes = saved(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*AT)).alias("first")).where("n > 1"), "classes")
    size = classes.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    if not size["n"]:
        return None
    named = ranked(classes, keys)
    if size["most"] * heavy <= size["n"]:
        return rows.join(named.drop("n"), keys).drop(*keys)
    named = saved(named, "named")
    large, rest = (named.where(f"n * {heavy}L {op} {size['n']}").drop("n") for op in (">", "<="))
    found = saved(rows.join(F.broadcast(large.withColumnsRenamed({"first": "f", "rank": "r"})), keys, "left"), "found")
    one = found.where("r is not null").withColumnsRenamed({"f": "first", "r": "rank"})
    two = found.where("r is null").drop("f", "r").join(rest, keys)
    return one.drop(*keys).unionByName(two.drop(*keys))


def doubled(lines: DataFrame) -> dict[int, DataFrame]:
    """By depth 1, 2, 4, ..: (doc, of, at, words, first, rank) of the suffixes whose first lines repeat."""
    spark, out, h = lines.sparkSession, {}, 1
    rows = intervals(lines.drop("line"), ["id", "id2"])
    # rows that agree in id and text are one from here on; a document's lines stay together for the windows below
    rows = rows if rows is None else rows.repartition(shuffle_partitions(spark), "doc", "of").dropDuplicates(AT)
    while rows is not None:
        out[h] = saved(rows, "suffixes")
        doc = Window.partitionBy("doc", "of").orderBy("at")
        # where a suffix between the two dropped out, the pair can't repeat
        pairs = out[h].select(*AT, "words", F.col("rank").alias("head"), F.lead("rank", h).over(doc).alias("tail"), F.lead("at", h).over(doc).alias("there"))
        rows = intervals(saved(pairs.where(f"there = at + {h}").drop("there"), "pairs"), ["head", "tail"])
        h *= 2
    return out


def longest_copies(levels: dict[int, DataFrame]) -> DataFrame:
    """(doc, of, at, words, lines, first): of each suffix that has an earlier copy the length of the longest."""
    self_ = F.struct(*AT)
    member, pool = [*AT, "words", "a", "b", "d", "first"], None
    for h in sorted(levels, reverse=True):
        rows = levels[h].select(*AT, "words", F.col("rank").alias("a"), F.lit(h).cast("long").alias("b"), F.lit(h).alias("d"), "first")
        if 2 * h in levels:  # of what shares 2h lines too the first alone stands for the others
            deeper = levels[2 * h].select(*AT, F.col("first").alias("deep"))
            rows = rows.join(deeper, AT, "left").where(F.col("deep").isNull() | (F.col("deep") == self_)).select(*member)
        pool = rows if pool is None else pool.union(rows)
        s = h // 2
        if not s:
            break
        ranks = levels[s].select("doc", "of", F.col("at").alias("there"), F.col("rank").alias("next"))
        pool = saved(pool.withColumn("there", F.col("at") + F.col("d")).join(ranks, ["doc", "of", "there"], "left").select(*member, "next"), "split")
        parts = pool.where("next is not null").groupBy("a", "b", "next").agg(F.count("*").alias("n"), F.min(self_).alias("top")).where("n > 1").drop("n")
        found = saved(pool.join(parts, ["a", "b", "next"], "left"), "parts")
        name = [F.xxhash64(F.lit(k), "a", "b", "next", F.lit(s)) for k in (2, 3)]
        deeper = found.where("top is not null").select(*AT, "words", name[0].alias("a"), name[1].alias("b"), (F.col("d") + s).alias("d"), F.col("top").alias("first"))
        pool = deeper.union(found.where(F.col("top").isNull() | (F.col("top") == self_)).select(*member))
    # the first of an interval is the first of one of its parts, or of none, and so has stood for itself all along
    return pool.where(self_ > F.col("first")).select(*AT, "words", F.col("d").alias("lines"), "first")


def repeated_runs(lines: DataFrame, min_lines: int = 4, min_words: int = 50) -> DataFrame:
    """(doc, of, at, lines, new, first): maximal runs of lines with an earlier copy, which begins at `first`;
    new: the place from which on the run's lines lie in no run before it."""
    levels = doubled(lines)
    if not levels:
        return lines.where(F.lit(False)).select(*AT, F.lit(0).alias("lines"), F.lit(0).alias("new"), F.struct(*AT).alias("first"))
    words = F.aggregate(F.slice("words", 1, F.col("lines")), F.lit(0), lambda s, x: s + x)
    rows = longest_copies(levels).where((F.col("lines") >= min_lines) | (words >= min_words))
    before = F.max(F.col("at") + F.col("lines")).over(Window.partitionBy("doc", "of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("ended", F.coalesce(before, F.lit(0))).where("at + lines > ended")
    return rows.select(*AT, "lines", F.greatest("at", "ended").alias("new"), "first")


def line_dedup(docs: DataFrame, min_lines: int = 4, min_words: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the later copies of repeated line runs deleted from the text; two columns are added:
    n_lines (non-blank lines before) and n_deleted."""
    lines = saved(line_sequence(docs, key, text, min_lines - 1), "lines")
    runs = repeated_runs(lines, min_lines, min_words)
    gone = runs.select("doc", "of", F.explode(F.sequence("new", F.col("at") + F.col("lines") - 1)).alias("at"))
    gone = lines.select(*AT, "line").join(gone, AT, "left_semi").distinct()
    # a document's own line numbers, packed; never more than its lines
    marks = saved(gone.groupBy("doc", "of").agg(F.sort_array(F.collect_set("line")).alias("gone")), "marks")
    # as flags by line, so that a document's cost grows with its lines, not with lines x deleted lines
    before = lambda i: F.coalesce(F.get("gone", i - 1), F.lit(-1))
    flags = F.flatten(F.transform("gone", lambda x, i: F.concat(F.array_repeat(F.lit(False), x - before(i) - 1), F.array(F.lit(True)))))
    marks = marks.select("doc", "of", F.size("gone").alias("n"), flags.alias("flags"))
    # texts and marks both grow with the input: always a sort-merge join, whatever the size today
    rows = docs.drop("n_lines", "n_deleted")
    held = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"))
    mine = F.col("row").getField(key), F.col("row").getField(text)
    joined = held.join(marks.hint("merge"), (mine[0] == F.col("doc")) & (F.xxhash64(mine[1]) == F.col("of")), "left")
    parts = F.split(mine[1], "\n", -1)
    left = F.array_join(F.filter(parts, lambda x, i: ~F.coalesce(F.get("flags", i), F.lit(False))), "\n")
    n = F.when(mine[0].isNull() | mine[1].isNull(), 0).otherwise(F.size(F.filter(parts, lambda x: F.length(F.trim(x)) > 0)))
    columns = [(F.when(F.col("n").isNull(), mine[1]).otherwise(left) if c == text else F.col("row").getField(c)).alias(c) for c in rows.columns]
    return joined.select(*columns, n.cast("long").alias("n_lines"), F.coalesce("n", F.lit(0)).cast("long").alias("n_deleted"))


def op1_line_dedup(spark, sf_dir):
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_deleted", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


OP1_SQL = r"""
with split as (
  select doc_id, text, string_split(text, chr(10)) as parts from documents where doc_id is not null and text is not null
), numbered as (
  select doc_id, unnest(parts) as s, unnest(range(len(parts))) as line from split
), full_lines as (
  select doc_id, s, line, row_number() over (partition by doc_id order by line) as pos,
         len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) as words
  from numbered where length(trim(s)) > 0
), ahead as (
  select *, lead(s, 1) over w as s1, lead(s, 2) over w as s2, lead(s, 3) over w as s3,
         lead(words, 1) over w as w1, lead(words, 2) over w as w2
  from full_lines window w as (partition by doc_id order by pos)
), later as (
  select doc_id, pos, 1 as n from (select *, row_number() over (partition by s order by doc_id, pos) as k from ahead) where k > 1 and words >= 50
  union all
  select doc_id, pos, 2 from (select *, row_number() over (partition by s, s1 order by doc_id, pos) as k from ahead where s1 is not null) where k > 1 and words + w1 >= 50
  union all
  select doc_id, pos, 3 from (select *, row_number() over (partition by s, s1, s2 order by doc_id, pos) as k from ahead where s2 is not null) where k > 1 and words + w1 + w2 >= 50
  union all
  select doc_id, pos, 4 from (select *, row_number() over (partition by s, s1, s2, s3 order by doc_id, pos) as k from ahead where s3 is not null) where k > 1
), gone as (
  select distinct doc_id, unnest(range(pos, pos + n)) as pos from later
), gone_lines as (
  select f.doc_id, f.line from full_lines f join gone g on f.doc_id = g.doc_id and f.pos = g.pos
), kept as (
  select n.doc_id, string_agg(n.s, chr(10) order by n.line) as text
  from numbered n left join gone_lines g on n.doc_id = g.doc_id and n.line = g.line where g.line is null group by n.doc_id
)
select d.doc_id, coalesce(f.n, 0) as n_lines, coalesce(g.n, 0) as n_deleted, md5(coalesce(k.text, '')) as text_md5
from documents d
left join (select doc_id, count(*) as n from full_lines group by doc_id) f on d.doc_id = f.doc_id
left join (select doc_id, count(*) as n from gone_lines group by doc_id) g on d.doc_id = g.doc_id
left join kept k on d.doc_id = k.doc_id
"""
