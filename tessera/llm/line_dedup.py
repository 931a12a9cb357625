"""Operator 6, line dedup by a log-template tree (DataFrame functions only).

A line's path in the tree is its number of tokens and its first `depth` tokens, tokens
with a digit standing as `<*>`. Where a leaf recurs as a whole and its lines agree in at
least `similarity` of their positions, they are one template, the other positions being
variable; in other leaves each masked line is its own template.

A template recurs when enough different texts hold it between different lines: of its
distinct (line before, line after) pairs, at least `min_contexts`, no line before (or no
line after) makes up more than one in `min_contexts`, and the pairs count for that many
documents. A document's start or end is no neighbour. Runs of lines that many texts share
are judged in the same way by what stands around the run, so the inner lines of a licence or a menu
go with its edges. The lines of exact and near copies of a document keep their neighbours
and are left to the duplicate operators.

The texts are read once into a written table of line hashes (again only for leaves that
may be templates) and move once, in the last join; all counting works on the hashes and
is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import MAX_ID, fresh, written

DEPTH, SIMILARITY, MIN_CONTEXTS = 4, 0.7, 5
OWN_LINES = 5       # a text of which fewer than one line in so many is its own is a near copy: its runs show nothing
BLANKS = "\t\r\x0b\x0c"


def _flat(text: Column) -> Column:
    """Blanks other than line breaks as spaces."""
    return F.when(text.rlike("[\t\r\x0b\x0c]"), F.translate(text, BLANKS, " " * len(BLANKS))).otherwise(text)


def _masked(line: Column) -> Column:
    """One space between tokens, none around; tokens with a digit become `<*>`."""
    flat = F.trim(line)
    flat = F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " +", " ")).otherwise(flat)
    return F.when(flat.rlike("[0-9]"), F.regexp_replace(flat, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(flat)


def _id(*cols: Column) -> Column:
    """128-bit identity of values as two longs."""
    return F.struct(F.xxhash64(*cols).alias("x"), F.xxhash64(F.lit(1), *cols).alias("y"))


def _lines(df: DataFrame, text_col: str, keys: list[Column], depth: int) -> DataFrame:
    """One row per line that isn't blank: keys, pos, masked line, its identity `own`, its
    `leaf`, and hashes of the lines around it."""
    names = [f"k{i}" for i in range(len(keys))]
    split = df.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)),
                      F.split(_flat(F.col(text_col)), "\n").alias("lines"))
    hashed = split.withColumn("h", F.transform("lines", lambda x: F.xxhash64(x)))
    near = F.transform("lines", lambda x, i: F.struct(
        x.alias("line"), F.when(i > 0, F.get("h", i - 1)).alias("before"), F.get("h", i + 1).alias("after")))
    rows = hashed.select(*names, F.posexplode(near).alias("pos", "v")).select(
        *names, "pos", "v.before", "v.after", _masked(F.col("v.line")).alias("masked"))
    tokens = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    return rows.where("masked <> ''").select(
        "*", _id(F.col("masked")).alias("own"),
        _id(tokens, F.substring_index("masked", " ", depth)).alias("leaf"))


def wide_leaves(lines: DataFrame, slim: DataFrame, similarity: float, min_contexts: int) -> DataFrame | None:
    """Leaves of several masked lines that recur as a whole and agree in enough positions
    to be one template. `slim` holds the same lines without their texts, written; only if
    such leaves exist are their lines read again."""
    found = recurring(slim.withColumnRenamed("leaf", "id"), min_contexts).withColumnRenamed("id", "leaf")
    several = (slim.groupBy("leaf").agg((F.min("own") != F.max("own")).alias("several")).where("several")
               .join(found, "leaf"))
    several = written(several.select("leaf"), "line-leaves")
    if several.isEmpty():
        return None
    tokens = (lines.join(several, "leaf", "left_semi").select("leaf", "masked").distinct()
              .select("leaf", F.posexplode(F.split("masked", " ")).alias("at", "token")))
    fixed = (tokens.groupBy("leaf", "at").agg((F.min("token") == F.max("token")).cast("int").alias("same"))
             .groupBy("leaf").agg(F.avg("same").alias("share")))
    return written(fixed.where(F.col("share") >= similarity).select("leaf"), "line-templates")


def _between(where: DataFrame, min_contexts: int) -> DataFrame:
    """Ids of distinct (id, before, after) that stand between different lines."""
    def side(c: str) -> DataFrame:
        top = F.when(F.col(c).isNotNull(), F.col("n")).otherwise(0)
        return (where.groupBy("id", c).agg(F.count("*").alias("n"))
                .groupBy("id").agg(F.sum("n").alias(f"all_{c}"), F.max(top).alias(f"top_{c}")))
    return (side("before").join(side("after"), "id")
            .where((F.col("all_before") >= min_contexts)
                   & (F.least("top_before", "top_after") * min_contexts <= F.col("all_before"))).select("id"))


def recurring(lines: DataFrame, min_contexts: int) -> DataFrame:
    """Templates (`id`) that recur over documents, alone or as part of a block.

    A template is shared if `min_contexts` different texts hold it. It recurs if it stands
    between different lines, or if the runs of shared lines that hold it do (blank lines
    don't break a run); the latter counts in texts of which at least one line in OWN_LINES is
    not shared, since the rest are near copies. A context counts for the least document that
    has it, and the contexts of a template must count for `min_contexts` documents."""
    shared = written(lines.select("id", "k1").distinct().groupBy("id").agg(F.count("*").alias("n"))
                     .where(F.col("n") >= min_contexts).select("id"), "line-shared")
    told = lines.select("k0", "k1", "pos", "id").join(shared.withColumn("shared", F.lit(True)), "id", "left").select(
        "k0", "k1", "pos", F.when(F.col("shared"), F.col("id")).alias("id"),
        F.when(F.col("shared").isNull(), F.col("id.x")).alias("line"))
    text = Window.partitionBy("k0", "k1")
    up, down = (text.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("pos"), F.desc("pos")))
    runs = told.select("k0", "id", F.last("line", True).over(up).alias("before"), F.last("line", True).over(down).alias("after"),
                       F.count("line").over(text).alias("own"), F.count("*").over(text).alias("all"))
    runs = runs.where(F.col("id").isNotNull() & (F.col("own") * OWN_LINES >= F.col("all")))
    alone = lines.join(shared, "id", "left_semi")
    found = []
    for rows in (alone, runs):
        where = written(rows.groupBy("id", "before", "after").agg(F.min("k0").alias("doc")), "line-contexts")
        texts = (where.select("id", "doc").distinct().groupBy("id").agg(F.count("*").alias("n"))
                 .where(F.col("n") >= min_contexts).select("id"))
        found.append(_between(where, min_contexts).join(texts, "id"))
    return found[0].union(found[1]).distinct()


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
               similarity: float = SIMILARITY, min_contexts: int = MIN_CONTEXTS,
               counts: bool = False) -> DataFrame:
    """`df` with its columns and rows, recurring template lines taken out of `text_col`;
    with `counts` also n_lines and n_dropped.

    Blank lines are no templates and stay. Null and empty texts have no lines and stay
    as they are; a text left without lines becomes empty. Repeated rows stay, each
    without its recurring lines; null ids are allowed. An empty table gives no rows.
    Helper columns take names that clash with none of `df`."""
    name = fresh(df, "n_lines", "n_dropped")
    k0, k1, gone, parts = (name(x) for x in ("k0", "k1", "gone", "parts"))
    keys = [F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_ID)).alias(k0), F.xxhash64(F.col(text_col)).alias(k1)]
    lines = _lines(df.where(F.col(text_col).isNotNull()), text_col, keys, depth)
    slim = written(lines.drop("masked"), "lines")
    leaves = wide_leaves(lines, slim, similarity, min_contexts)
    own = F.col("own")
    if leaves is not None:
        slim = slim.join(leaves.withColumn("wide", F.lit(True)), "leaf", "left")
        own = F.when(F.col("wide"), F.col("leaf")).otherwise(own)
    ided = slim.select("k0", "k1", "pos", "before", "after", own.alias("id"))
    drop = (ided.join(written(recurring(ided, min_contexts), "line-recurring"), "id", "left_semi")
            .groupBy(F.col("k0").alias(k0), F.col("k1").alias(k1)).agg(F.collect_set("pos").alias(gone)))
    n = F.when(F.length(text_col) > 0, F.size(parts)).otherwise(0)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone)),
                                    lambda i: F.get(parts, i)), "\n")
    out = df.select("*", *keys).join(drop, [k0, k1], "left").withColumn(parts, F.split(F.col(text_col), "\n"))
    cols = [F.when(F.col(gone).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c)
            for c in df.columns]
    if counts:
        cols += [F.coalesce(n, F.lit(0)).cast("long").alias("n_lines"),
                 F.coalesce(F.when(F.col(gone).isNotNull(), F.size(gone)), F.lit(0)).cast("long").alias("n_dropped")]
    return out.select(*cols)


def _recurring_sql(name: str, src: str) -> str:
    """`recurring` of the rows (id, doc_id, text, pos, b, a) of `src`, as table `name`."""
    side = lambda c: (f"select k, id, sum(n) as total, max(case when {c} is null then 0 else n end) as top from "  # noqa: E731
                      f"(select k, id, {c}, count(*) as n from {name}_ctx group by k, id, {c}) group by k, id")
    return f"""
{name}_shared as (select id from {src} group by id having count(distinct text) >= 5),
{name}_told as (select s.doc_id, s.pos, case when h.id is not null then s.id end as id, case when h.id is null then s.id end as line
                from {src} s left join {name}_shared h on s.id = h.id),
{name}_runs as (select id, doc_id,
                last_value(line ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as b,
                first_value(line ignore nulls) over (partition by doc_id order by pos rows between 1 following and unbounded following) as a,
                count(line) over (partition by doc_id) as own, count(*) over (partition by doc_id) as total from {name}_told),
{name}_rows as (select 1 as k, id, b, a, doc_id from {src} semi join {name}_shared using (id)
                union all select 2, id, b, a, doc_id from {name}_runs where id is not null and own * 5 >= total),
{name}_ctx as (select k, id, b, a, min(doc_id) as d from {name}_rows group by k, id, b, a),
{name}_docs as (select k, id from {name}_ctx group by k, id having count(distinct d) >= 5),
{name}_b as ({side("b")}),
{name}_a as ({side("a")}),
{name} as (select distinct id from {name}_b join {name}_a using (k, id) semi join {name}_docs using (k, id)
           where {name}_b.total >= 5 and least({name}_b.top, {name}_a.top) * 5 <= {name}_b.total)"""


#: DuckDB SQL of the same, for `documents`: doc_id, n_lines, n_dropped and the text left.
ORACLE = rf"""
with raw as (select doc_id, coalesce(text, '') as text, unnest(string_split(text, chr(10))) as line,
                    unnest(range(len(string_split(text, chr(10))))) as pos from documents where text is not null),
blank as (select *, translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    ') as z from raw),
flat as (select *, trim(regexp_replace(z, ' +', ' ', 'g')) as f from blank),
masked as (select *, regexp_replace(f, '[^ ]*[0-9][^ ]*', '<*>', 'g') as m from flat),
near as (select *, lag(z) over (partition by doc_id order by pos) as b,
                lead(z) over (partition by doc_id order by pos) as a from masked),
tok as (select *, string_split(m, ' ') as t from near where m <> ''),
leaf as (select *, len(t) || ' ' || array_to_string(t[1:4], ' ') as lid from tok),
leaves as (select lid as id, doc_id, text, pos, b, a from leaf),
{_recurring_sql("lrec", "leaves")},
forms as (select distinct lid, m, t from leaf),
several as (select lid from forms group by lid having count(*) >= 2),
cells as (select lid, unnest(t) as x, unnest(range(len(t))) as j from forms semi join several using (lid) semi join lrec on lid = lrec.id),
same as (select lid, j, min(x) = max(x) as s from cells group by lid, j),
wide as (select lid from same group by lid having avg(s::int) >= 0.7),
ided as (select case when wide.lid is not null then 'leaf ' || leaf.lid else 'line ' || m end as id, doc_id, text, pos, b, a
         from leaf left join wide using (lid)),
{_recurring_sql("rec", "ided")},
gone as (select distinct doc_id, pos from ided semi join rec using (id)),
kept as (select raw.doc_id, count(*) as n_kept, string_agg(line, chr(10) order by pos) as txt
         from raw anti join gone using (doc_id, pos) group by raw.doc_id),
total as (select doc_id, case when any_value(text) = '' then 0 else count(*) end as n_lines from raw group by doc_id),
lost as (select doc_id, count(*) as n_dropped from gone group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped,
       sha256(coalesce(txt, '')) as text_sha256
from documents d left join total using (doc_id) left join lost using (doc_id) left join kept using (doc_id)
"""
