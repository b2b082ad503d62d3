"""Maintenance of document, keyword and job tables: upserts, skips, merges, inventories, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendspark.functions.lineage import checkpoint
from trendspark.functions.order import numbered
from trendspark.functions.text import normalize

# ------------------------------------------------------------------ identities


def doc_id(keyword: Column, url: Column) -> Column:
    return F.md5(F.concat(keyword, F.lit("::"), url))


def point_id(parent: Column, index: Column) -> Column:
    """Version 5 UUID of parent::index in the DNS name space."""
    space = F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(space, F.concat(parent.cast("string"), F.lit("::"), index.cast("string")).cast("binary")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def cache_key(version: str, keyword: Column, sources: Column, all_sources: list[str], distinct: Column | None = None) -> Column:
    """sha256 of the request; naming all sources is the same as naming none."""
    every = F.size(F.array_distinct(sources)).eqNullSafe(F.lit(len(all_sources))) & F.forall(sources, lambda s: s.isin(all_sources))
    names = F.when(F.coalesce(every, F.lit(False)) | sources.isNull(), "").otherwise(F.array_join(F.array_sort(sources), ","))
    return F.sha2(F.concat_ws("|", F.lit(version), keyword, names, *([F.array_join(distinct, ",")] if distinct is not None else [])), 256)


# ------------------------------------------------------------------ upserts


def _rest(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key; rows of updates go before rows of base on ties."""
    both = base.withColumn("__u", F.lit(0)).unionByName(updates.withColumn("__u", F.lit(1)))
    row = F.max_by(F.struct(*_rest(base, keys)), F.struct(F.col(order), F.col("__u"))).alias("r")
    return both.groupBy(*keys).agg(row).select(*keys, *[F.col("r")[c].alias(c) for c in _rest(base, keys)])


def insert_new(base: DataFrame, incoming: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, one row of saved and skipped counts): the first of each new key goes in."""
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*_rest(incoming, [key])), order).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in _rest(incoming, [key])])
    new = first.join(base.select(key), key, "left_anti")
    counts = new.agg(F.count("*").alias("saved")).join(F.broadcast(incoming.agg(F.count("*").alias("n")))).select("saved", (F.col("n") - F.col("saved")).alias("skipped"))
    return new.select(incoming.columns), counts


def insert_defaults(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return base.unionByName(new.dropDuplicates([key]).join(base.select(key), key, "left_anti"))


def replace_by_parent(points: DataFrame, new: DataFrame, parents: DataFrame) -> DataFrame:
    """All rows of the parents make way for the new ones, also where there are none."""
    return points.join(parents.select("parent_id"), "parent_id", "left_anti").unionByName(new)


# ------------------------------------------------------------------ skips and unions


def skip_saved(candidates: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates not saved yet, (keyword, n_skipped))."""
    c = candidates.withColumn("_id", doc_id(F.col("keyword"), F.col("url")))
    skipped = c.join(docs.select("_id"), "_id", "left_semi").groupBy("keyword").agg(F.count("*").alias("n_skipped"))
    return c.join(docs.select("_id"), "_id", "left_anti"), skipped


def skip_rejected(candidates: DataFrame, rejects: DataFrame, now: Column, days: int = 30) -> DataFrame:
    fresh = rejects.where(F.col("rejected_at") >= now - F.make_dt_interval(F.lit(days))).select("_id")
    return candidates.join(fresh, "_id", "left_anti")


def recently_collected(keywords: DataFrame, docs: DataFrame, source: str, now: Column, days: int = 3) -> DataFrame:
    fresh = docs.where((F.col("source") == source) & (F.col("crawled_at") >= now - F.make_dt_interval(F.lit(days)))).select("keyword").distinct()
    return keywords.join(fresh.withColumn("recent", F.lit(True)), "keyword", "left").withColumn("recent", F.coalesce("recent", F.lit(False)))


def union_first(lists: DataFrame, key: str) -> DataFrame:
    """Of rows with list_no and pos, the first of each key by list, then position."""
    rest = _rest(lists, [key])
    return lists.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("list_no", "pos")).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in rest])


def split_budget(lists: DataFrame, key: str, most: int) -> DataFrame:
    """The first most // n of each of n orderings (list_no, pos), then the first of each key."""
    n = lists.select("list_no").distinct().agg(F.count("*").alias("n_lists"))
    rank = F.row_number().over(Window.partitionBy("list_no").orderBy("pos"))
    cut = lists.withColumn("__rank", rank).join(F.broadcast(n)).where(F.col("__rank") <= F.floor(F.lit(most) / F.col("n_lists"))).drop("__rank", "n_lists")
    return union_first(cut, key)


def with_parents(chunks: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    return chunks.join(docs.select(F.col("_id").alias("parent_id"), *columns), "parent_id")


def pending_cleaned(raw: DataFrame, cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cleaned documents of pending raw ones, one row with the number of those not cleaned yet)."""
    ids = raw.where(~F.coalesce(F.col("is_embedded"), F.lit(False))).select("_id")
    return cleaned.join(ids, "_id", "left_semi"), ids.join(cleaned.select("_id"), "_id", "left_anti").agg(F.count("*").alias("n_unprocessed"))


def visible_keywords(docs: DataFrame, hidden: DataFrame) -> DataFrame:
    return docs.where("is_embedded").select("keyword").distinct().join(hidden.select("keyword"), "keyword", "left_anti")


def keyword_set_change(keywords: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    return keywords.select("keyword").union(add.select("keyword")).distinct().join(remove.select("keyword"), "keyword", "left_anti")


LISTED, LISTED_CHARS = 2_000, 200_000  # of a keyword list that is broadcast


def cross_df(docs: DataFrame, keywords: DataFrame, text: str = "norm", demote: float = 0.1) -> DataFrame:
    """For each keyword, the share of other keywords' documents that hold it; frequent ones are to be demoted.

    docs: (keyword, norm); keywords: (keyword, norm). A list of at most LISTED keywords and LISTED_CHARS
    characters is broadcast as one array: the documents are scanned once, and only counts are
    shuffled. A longer one is joined by its keywords' first two characters with those pairs that
    each document has: only the documents' numbers go with the pairs, and the texts are joined once
    to the keywords found that way.
    """
    rows, chars = keywords.agg(F.count("*"), F.coalesce(F.sum(F.length("norm") + F.length("keyword")), F.lit(0))).first()
    if rows <= LISTED and chars <= LISTED_CHARS:
        listed = keywords.agg(F.collect_set(F.struct("keyword", F.col("norm").alias("k"))).alias("ks"))
        pairs = docs.join(F.broadcast(listed)).select(F.col("keyword").alias("own"), F.explode(F.filter("ks", lambda x: (x["k"] != "") & F.contains(F.col(text), x["k"]))["keyword"]).alias("keyword"))
    else:
        named = keywords.where("norm <> ''").distinct().select(F.col("keyword").alias("other"), F.col("norm").alias("k"), F.substring("norm", 1, 2).alias("piece"))
        at = F.sequence(F.lit(1), F.greatest(F.length("__t"), F.lit(1)))
        pieces = F.flatten(F.transform(at, lambda i: F.array(F.substring(F.col("__t"), i, F.lit(1)), F.substring(F.col("__t"), i, F.lit(2)))))
        # numbered in a checkpoint, as a task that runs again may number other rows
        texts = checkpoint(docs.select(F.col("keyword").alias("own"), F.col(text).alias("__t"), F.monotonically_increasing_id().alias("__n")))
        found = texts.select("__n", F.explode(F.array_distinct(pieces)).alias("piece")).join(named, "piece").select("__n", "other", "k")
        pairs = found.join(texts, "__n").where(F.contains("__t", F.col("k"))).select("own", F.col("other").alias("keyword"))
    hits = pairs.where("own <> keyword").groupBy("keyword").agg(F.count("*").alias("cross_match"))
    size = docs.groupBy("keyword").agg(F.count("*").alias("own_docs"))
    total = size.agg(F.sum("own_docs").alias("total"))
    out = keywords.select("keyword").join(size, "keyword", "left").join(hits, "keyword", "left").join(F.broadcast(total)).na.fill(0, ["own_docs", "cross_match"])
    share = F.when(F.col("total") > F.col("own_docs"), F.col("cross_match") / (F.col("total") - F.col("own_docs"))).otherwise(0.0)
    return out.select("keyword", "own_docs", "cross_match", share.alias("cross_df"), (share >= demote).alias("demote"))


def similar_keywords(inputs: DataFrame, keywords: DataFrame, least: int = 2, nfc: bool = True) -> DataFrame:
    """(input, keyword) pairs whose normal forms are equal or hold one another; equal raw strings are left out.

    The join is on shared pieces of `least` characters that the shorter form begins with, so it
    is an equi-join: every containing form has that piece.
    """
    norm = lambda df, name: df.select(F.col("keyword").alias(name), normalize(F.col("keyword"), nfc).alias(f"n_{name}")).where(F.length(f"n_{name}") >= least).distinct()
    a, b = norm(inputs, "input"), norm(keywords, "keyword")
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - least + 1), lambda i: F.substring(c, i, F.lit(least))))
    head = lambda c: F.substring(c, 1, least)
    inside = a.withColumn("p", head(F.col("n_input"))).join(b.withColumn("p", F.explode(pieces(F.col("n_keyword")))), "p").where(F.contains("n_keyword", F.col("n_input")))
    around = a.withColumn("p", F.explode(pieces(F.col("n_input")))).join(b.withColumn("p", head(F.col("n_keyword"))), "p").where(F.contains("n_input", F.col("n_keyword")))
    return inside.unionByName(around).where("input <> keyword").select("input", "keyword").distinct()


def eval_set(keywords: DataFrame, templates: list[str]) -> DataFrame:
    t = F.array(*map(F.lit, templates))
    x = keywords.select("keyword", F.posexplode(t).alias("i", "template"))
    return x.select(F.concat("keyword", F.lit("__t"), F.col("i").cast("string")).alias("query_id"), "keyword", "template", F.replace("template", F.lit("{keyword}"), F.col("keyword")).alias("question"))


def usable_keywords(keywords: DataFrame, docs: DataFrame) -> DataFrame:
    have = docs.where("is_embedded").select("keyword", F.lit(True).alias("usable")).distinct()
    return keywords.join(have, "keyword", "left").withColumn("usable", F.coalesce("usable", F.lit(False)))


def keyword_inventory(analyzable: DataFrame, configured: DataFrame, docs: DataFrame) -> DataFrame:
    """All keywords of either list with their number of documents and whether they are configured."""
    n = docs.groupBy("keyword").agg(F.count("*").alias("n_docs"))
    every = analyzable.select("keyword").union(configured.select("keyword")).distinct()
    out = every.join(n, "keyword", "left").join(configured.select("keyword", F.lit(True).alias("configured")).distinct(), "keyword", "left")
    return out.select("keyword", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("configured", F.lit(False)).alias("configured"))


def audit_lineage(chunks: DataFrame, docs: DataFrame, n: int = 30) -> DataFrame:
    """Whether each chunk's first characters are in its parent's content: ok, altered or parent_missing."""
    out = chunks.join(docs.select(F.col("_id").alias("parent_id"), F.col("content").alias("__content")), "parent_id", "left")
    verdict = F.when(F.col("__content").isNull(), "parent_missing").when(F.contains("__content", F.substring("text", 1, n)), "ok").otherwise("altered")
    return out.select(*chunks.columns, verdict.alias("lineage"))


# ------------------------------------------------------------------ counts and reports


def analyzable_keywords(docs: DataFrame) -> DataFrame:
    return docs.where("is_embedded").select("keyword").distinct().orderBy("keyword")


def docs_by_source(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """Total and count by source of each asked keyword; none is 0 and an empty map."""
    c = docs.groupBy("keyword", "source").agg(F.count("*").alias("n")).groupBy("keyword").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("by_source"))
    out = keywords.join(c, "keyword", "left")
    return out.select("keyword", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("by_source", F.create_map().cast("map<string,bigint>")).alias("by_source"))


def needs_supplement(counts: DataFrame, wiki: str, least: int = 5) -> DataFrame:
    g = counts.groupBy("keyword").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("source") == wiki, F.col("n"))), F.lit(0)).alias("wiki"))
    return g.select("keyword", "total", "wiki", ((F.col("total") < least) | (F.col("wiki") == 0)).alias("due"))


def collection_report(log: DataFrame, sources: list[str]) -> DataFrame:
    """A row for each keyword and source in the fixed order; sources that did not run say so."""
    k = log.select("keyword").distinct().select("keyword", F.posexplode(F.array(*map(F.lit, sources))).alias("place", "source"))
    out = k.join(log, ["keyword", "source"], "left")
    return out.select("keyword", "place", "source", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("status", F.lit("not_run")).alias("status"))


def fallback_due(log: DataFrame, primary: str) -> DataFrame:
    """Keywords whose newest run of the primary source failed; one that found nothing did not fail."""
    last = log.where(F.col("source") == primary).groupBy("keyword").agg(F.max_by("status", "ran_at").alias("status"))
    return last.where(F.startswith("status", F.lit("failed"))).select("keyword", "status")


def affected_keywords(embedded: DataFrame) -> DataFrame:
    return embedded.groupBy("keyword").agg(F.count("*").alias("document_count"), F.countDistinct("source").alias("source_count"))


def low_confidence(evidence: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    return evidence.groupBy(*by).agg(F.countDistinct("url").alias("n_urls")).withColumn("low_confidence", F.col("n_urls") < least)


def stage_timings(log: DataFrame) -> DataFrame:
    g = log.groupBy("stage").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("calls"))
    total = g.agg(F.sum("seconds").alias("__all"))
    return g.join(F.broadcast(total)).select("stage", "seconds", "calls", F.when(F.col("__all") > 0, 100 * F.col("seconds") / F.col("__all")).alias("share")).orderBy(F.desc("seconds"), "stage")


def cache_snapshot(keywords: DataFrame, jobs: DataFrame) -> DataFrame:
    return keywords.join(jobs.select("keyword", "status"), "keyword", "left").groupBy(F.coalesce("status", F.lit("missing")).alias("status")).agg(F.count("*").alias("n"))


def eval_history(runs: DataFrame, n: int) -> DataFrame:
    """(keyword, run_at, warned_pct) of the last n runs, latest runs found by a bounded top-n."""
    last = runs.select("run_at").distinct().orderBy(F.desc("run_at")).limit(n)
    return runs.join(F.broadcast(last), "run_at").select("keyword", "run_at", "warned_pct")


def context_noise(merged: DataFrame, valid: Column) -> DataFrame:
    return merged.groupBy("keyword").agg(F.count("*").alias("total"), F.count_if(~valid).alias("warned"), (100 * F.avg((~valid).cast("double"))).alias("warned_pct"))


def needs_evidence(evidence: DataFrame, by: list[str], total: int = 1500, longest: int = 500) -> DataFrame:
    g = evidence.groupBy(*by).agg(F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))
    return g.withColumn("due", (F.col("chars") < total) | (F.col("longest") < longest))


def run_metrics(evidence: DataFrame, by: list[str]) -> DataFrame:
    return evidence.groupBy(*by).agg(F.sum(F.length("text")).alias("context_chars"), F.count("*").alias("source_count"))


def funnel(events: DataFrame) -> DataFrame:
    """(run, stage) -> in, out and a map of drops by reason, of rows (run, stage, event, reason, n)."""
    per = events.groupBy("run", "stage", "event", "reason").agg(F.sum("n").alias("n"))
    pick = lambda e: F.coalesce(F.sum(F.when(F.col("event") == e, F.col("n"))), F.lit(0))
    drops = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("event") == "drop", F.struct("reason", "n")))))
    return per.groupBy("run", "stage").agg(pick("in").alias("n_in"), pick("out").alias("n_out"), drops.alias("dropped"))


def quality_summary(chunks: DataFrame) -> DataFrame:
    """Counts of broken rules and the integer median length of each run (mean of the middle two, rounded down)."""
    rule = lambda r: F.count_if(F.array_contains("violations", r)).alias(r)
    median = F.floor(F.percentile("char_count", F.lit(0.5))).alias("median_length")
    return chunks.groupBy("run").agg(F.count("*").alias("n_chunks"), median, *[rule(r) for r in ("short", "spam", "no_keyword", "late_match", "low_hangul", "boilerplate")])


def compare_runs(summary: DataFrame, a: str, b: str) -> DataFrame:
    names = [c for c in summary.columns if c != "run"]
    long = summary.select("run", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("long") for c in names]))).alias("metric", "value"))
    get = lambda r: F.max(F.when(F.col("run") == r, F.col("value")))
    return long.groupBy("metric").agg(get(a).alias("before"), get(b).alias("after")).withColumn("delta", F.col("after") - F.col("before"))


def worst_chunks(chunks: DataFrame, n: int) -> DataFrame:
    return chunks.orderBy(F.desc(F.size("violations")), "chunk_id").limit(n)


def judge_score(labels: DataFrame) -> DataFrame:
    """Confusion counts, accuracy, precision and recall; positive is a contaminated document (label 0). 0 without a denominator."""
    bad, said = F.col("human_label") == 0, F.col("judge_matched") == 0
    g = labels.agg(F.count_if(bad & said).alias("tp"), F.count_if(~bad & said).alias("fp"), F.count_if(bad & ~said).alias("fn"), F.count_if(~bad & ~said).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.select("tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))


def agreement_by(labels: DataFrame, columns: list[str]) -> DataFrame:
    """Agreement rate and relevant share by each column, of one grouping-sets pass."""
    g = labels.groupingSets([[c] for c in columns], *columns).agg(
        F.count("*").alias("n"), F.avg((F.col("human_label") == F.col("judge_matched")).cast("double")).alias("agreement"), F.avg(F.col("human_label").cast("double")).alias("relevant"))
    dim = F.coalesce(*[F.when(F.col(c).isNotNull(), c) for c in columns])
    return g.select(dim.alias("dimension"), F.coalesce(*[F.col(c).cast("string") for c in columns]).alias("value"), "n", "agreement", "relevant")


def relevance_distribution(docs: DataFrame) -> DataFrame:
    g = docs.groupBy("is_relevant", "relevance_position").agg(F.count("*").alias("n"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("__all")))).select("is_relevant", "relevance_position", "n", (F.col("n") / F.col("__all")).alias("share"))


def stratified_sample(docs: DataFrame, n: int, suspects: list[str], order: Column, positions: tuple[str, ...] = ("title", "early", "late", "none")) -> DataFrame:
    """Round robin over (position, source): a suspect source has four picks a round, others one.

    The k-th document of a bucket comes in round (k - 1) div picks. Within a round, positions go
    in order, suspects three times first, then all sources by name. order: a seeded hash.
    """
    rank = F.row_number().over(Window.partitionBy("source", "position").orderBy(order))
    suspect = F.col("source").isin(*suspects) if suspects else F.lit(False)
    picks = F.when(suspect, 4).otherwise(1)
    out = docs.withColumn("__k", rank - 1).withColumn("__round", F.floor(F.col("__k") / picks)).withColumn("__slot", F.when(suspect, F.col("__k") % 4).otherwise(0))
    place = F.array_position(F.array(*map(F.lit, positions)), F.col("position"))
    early = suspect & (F.col("__slot") < 3)
    at = F.when(early, F.array_position(F.array(*map(F.lit, suspects)), F.col("source")) * 3 + F.col("__slot")).otherwise(1_000_000) if suspects else F.lit(1_000_000)
    out = out.withColumn("__place", place).withColumn("__at", at.cast("long"))
    return out.orderBy("__round", "__place", "__at", "source").limit(n).select(docs.columns)


def queue_positions(queue: DataFrame) -> DataFrame:
    """Place and estimated wait in minutes of the queued requests, oldest first (no time first)."""
    q = numbered(queue.where("status = 'queued'"), [F.col("requested_at").asc_nulls_first(), F.col("_id")], "position")
    return q.withColumn("position", F.col("position").cast("int")).withColumns({"wait_least": F.col("position") * 20, "wait_most": F.col("position") * 40})


# ------------------------------------------------------------------ keywords and jobs


def merge_keywords(table: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows of source keywords get the target's; equal names change nothing."""
    m = mapping.where("source_keyword <> target_keyword").select(F.col("source_keyword").alias("keyword"), "target_keyword")
    return table.join(m, "keyword", "left").withColumn("keyword", F.coalesce("target_keyword", "keyword")).drop("target_keyword").select(table.columns)


def delete_hidden(table: DataFrame, keywords: DataFrame, hidden: DataFrame) -> DataFrame:
    """Rows of the keywords go, but only of those that are hidden."""
    gone = keywords.select("keyword").join(hidden.select("keyword"), "keyword", "left_semi")
    return table.join(gone, "keyword", "left_anti")


def purge(docs: DataFrame, candidates: DataFrame, include_raw: bool = False) -> DataFrame:
    """Raw documents of purged parents are flagged judge_excluded, or dropped with include_raw."""
    ids = candidates.select(F.col("parent_id").alias("_id"))
    if include_raw:
        return docs.join(ids, "_id", "left_anti")
    return docs.join(ids.withColumn("judge_excluded", F.lit(True)), "_id", "left").withColumn("judge_excluded", F.coalesce("judge_excluded", F.lit(False)))


def reset_for_reprocessing(docs: DataFrame, keyword: str | None = None, source: str | None = None, all_sources: bool = False) -> DataFrame:
    """is_embedded = false in scope, with `changed` for rows that were true. A scope must be named, or all asked for."""
    if not (keyword or source or all_sources):
        raise ValueError("name a keyword or a source, or ask for all_sources")
    scope = F.lit(True)
    if keyword:
        scope = scope & (F.col("keyword") == keyword)
    if source:
        scope = scope & (F.col("source") == source)
    return docs.withColumn("changed", scope & F.col("is_embedded")).withColumn("is_embedded", F.col("is_embedded") & ~scope)


def backfill_relevance(docs: DataFrame, points: DataFrame, match: Column) -> tuple[DataFrame, DataFrame]:
    """Relevance columns where they are missing, computed once a document, and the same for its points."""
    missing = F.col("is_relevant").isNull()
    m = docs.withColumn("__m", F.when(missing, match))
    filled = m.select(*[c for c in docs.columns if c not in ("is_relevant", "relevance_position")], F.coalesce("is_relevant", F.col("__m.matched")).alias("is_relevant"), F.coalesce("relevance_position", F.col("__m.position")).alias("relevance_position"), missing.alias("filled"))
    known = filled.select(F.col("_id").alias("parent_id"), F.col("is_relevant").alias("__r"))
    out = points.join(known, "parent_id", "left").withColumn("is_relevant", F.coalesce("is_relevant", "__r")).drop("__r")
    return filled, out


def stuck_jobs(jobs: DataFrame, now: Column, minutes: int) -> DataFrame:
    late = jobs.where((F.col("status") == "running") & (F.col("started_at") < now - F.make_dt_interval(mins=F.lit(minutes))))
    return late.groupBy("kind").agg(F.count("*").alias("n"), F.min("started_at").alias("oldest"))


def refresh_on_evidence(queue: DataFrame, docs: int = 2, sources: int = 2) -> DataFrame:
    return queue.withColumn("outcome", F.when((F.col("document_count") >= docs) & (F.col("source_count") >= sources), "refresh").otherwise("unchanged"))


def invalidate_cache(jobs: DataFrame, changed: DataFrame) -> DataFrame:
    """Finished analyses of changed keywords go; other jobs stay."""
    c = changed.select("keyword").distinct().withColumn("__changed", F.lit(True))
    return jobs.join(c, "keyword", "left").where("__changed is null or status <> 'done'").drop("__changed")


def promote_keywords(counts: DataFrame, listed: DataFrame, least: int = 5, cap: int = 60) -> DataFrame:
    """New keywords with enough documents join the daily list by count until it is full; the rest are marked 'cap'."""
    new = counts.where(F.col("n") >= least).join(listed.select("keyword"), "keyword", "left_anti")
    used = listed.agg(F.count("*").alias("used"))
    return numbered(new, [F.desc("n"), F.col("keyword")], "rank").join(F.broadcast(used)).select("keyword", "n", F.when(F.col("used") + F.col("rank") <= cap, "promoted").otherwise("cap").alias("outcome"))


def record_rejects(gated: DataFrame, now: Column) -> DataFrame:
    """Rejects with a reason worth keeping: too_short, irrelevant or image_only; not network or parse failures."""
    return gated.where(F.col("reason").isin("too_short", "irrelevant", "image_only")).select(doc_id(F.col("keyword"), F.col("url")).alias("_id"), "keyword", "url", "source", "reason", now.alias("rejected_at"))


def keyword_readiness(keywords: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    d = docs.groupBy("keyword").agg(F.count("*").alias("n_docs"))
    c = chunks.groupBy("keyword").agg(F.count("*").alias("n_chunks"))
    out = keywords.join(d, "keyword", "left").join(c, "keyword", "left").na.fill(0, ["n_docs", "n_chunks"])
    return out.withColumn("verdict", F.when(F.col("n_docs") == 0, "nothing_collected").when(F.col("n_chunks") == 0, "nothing_left").otherwise("ready"))
