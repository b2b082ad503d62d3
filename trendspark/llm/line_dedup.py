"""Line dedup: explode normalised lines, hash, count documents, drop frequent lines, reassemble. Native."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm.common import SPACE_CHARS, ascii_lower, checkpoint, table


def _keys(lines, min_chars: int):
    """128-bit hash of each line's key; null where the key is shorter than min_chars."""
    key = lambda x: ascii_lower(F.trim(x, F.lit(SPACE_CHARS)))
    hashed = lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("line"), k).alias("h2"))
    return F.transform(F.transform(lines, key), lambda k: F.when(F.length(k) >= min_chars, hashed(k)))


def line_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop the lines whose key occurs in at least min_docs documents, but for those of the largest id.

    Returns all columns of docs with the text rebuilt, and n_lines and n_dropped (columns of docs
    with these names are replaced). A null or empty text is one empty line, and comes back as ''.
    Rows that share an id count as one document. Rows with a null id keep all their lines and
    count for no key. Lines keep their order; equal lines in the keeping document all stay.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # one pass over the texts: the place and hash of every line that counts; rows that share an id are told by their texts
    each = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), F.posexplode(_keys(F.split(text, "\n"), min_chars)).alias("pos", "k"))
    seen = checkpoint(each.where("k is not null").select("id", "t", "pos", "k.h1", "k.h2"))
    # distinct first, then counts that are pre-aggregated before the shuffle
    counts = seen.select("id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
    frequent = checkpoint(counts.where(F.col("n") >= min_docs).select("h1", "h2", "keeper"))
    # both sides are written tables, so that Spark can split the join at a very common line
    drops = seen.join(frequent, ["h1", "h2"]).where("id <> keeper").groupBy(F.col("id").alias("__id"), F.col("t").alias("__t")).agg(F.collect_set("pos").alias("__drop"))
    out = docs.withColumn("__u", F.xxhash64(text)).join(drops, (F.col(id_col) == F.col("__id")) & (F.col("__u") == F.col("__t")), "left")
    out = out.withColumn("__lines", F.split(text, "\n"))
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    kept = F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(F.transform(places, lambda i: F.get(F.col("__lines"), i)))
    # one row from a one-element array: filters on what follows can't be moved below and repeat the work above
    out = out.select("*", F.explode(F.array(kept)).alias("__kept"))
    out = (
        out.withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("n_dropped", (F.size("__lines") - F.size("__kept")).cast("long"))
        .withColumn(text_col, F.array_join("__kept", "\n"))
    )
    return out.select(*docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
k as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (
  select key, max(doc_id) as keeper from k where length(key) >= 20
  group by key having count(distinct doc_id) >= 3),
m as (
  select k.*, f.keeper is not null and k.doc_id <> f.keeper as dropped from k left join f using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (where dropped)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from m group by doc_id
"""
