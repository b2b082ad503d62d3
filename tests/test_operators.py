"""Small cases of text, tables, retrieval and stream operators."""

import datetime as dt
import difflib
import html
import random
import unicodedata

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trendspark.functions import text, urls
from trendspark.functions.order import numbered
from trendspark.operators import candidates, chunks, dedup, evaluation, gates, retrieval, tables
from trendspark.sources import io
from trendspark.streaming import jobs


def value(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in cols.items()))
    return df.select(expr.alias("v")).first().v


def test_clean_text(spark):
    raw = "<b>a&amp;b</b>  ㅋㅋㅋㅋㅋ me@x.org 010-1234-5678\n\n\n\nhttps://a.b/c 구독하기 end "
    assert value(spark, text.clean_text(F.col("t")), t=raw) == "a&b ㅋㅋㅋ [EMAIL] [PHONE]\n\nend"
    assert value(spark, text.clean_text(F.col("t")), t=None) == ""
    odd = "&eacute;&#x41; x"
    assert value(spark, text.clean_text(F.col("t"), all_entities=True), t=odd) == html.unescape(odd)


def test_normalize_composes_and_folds(spark):
    t = unicodedata.normalize("NFD", "É 가~ Straße")
    assert value(spark, text.normalize(F.col("t")), t=t) == "é가strasse"


def test_match_positions(spark):
    m = lambda k, t, b: value(spark, text.match_keyword(F.col("k"), F.col("t"), F.col("b")), k=k, t=t, b=b)
    assert tuple(m("a b~", "xAB", "ab ab")) == (True, "title", 3)
    assert m("kw", "", "x" * 199 + "kw").position == "early" and m("kw", "", "x" * 200 + "kw").position == "late"
    assert tuple(m("", "a", "b")) == (False, "none", 0) and m("kw", "a", "b").position == "none"


def test_profanity_spares_place_names(spark):
    assert value(spark, text.soften_profanity(F.col("t")), t="한남동 한남 병신") == "한남동 [욕설] [욕설]"
    assert value(spark, text.soften_profanity(F.col("t")), t=None) is None


def test_urls(spark):
    assert value(spark, urls.repair_url(F.col("u")), u="/l/?uddg=1&u=https%253A%252F%252Fa.b%252Fc%2Bd") == "https://a.b/c+d"
    assert value(spark, urls.repair_url(F.col("u")), u="/goto?url=abc") == "링크 없음"
    i = value(spark, urls.source_identity(F.col("u")), u="https://X.tistory.com/m/%ED%95%9C/?a=1")
    assert tuple(i) == ("x.tistory.com", "/한", "a=1")


def split_directly(text, size=500, overlap=50, separators=("\n\n", "\n", ". ", " ", "")):
    """The splitting rule as lists of pieces, one text at a time."""
    level = next(i for i, x in enumerate(separators) if x == "" or x in text)
    sep, finer = separators[level], separators[level + 1 :]
    parts = text.split(sep) if sep else list(text)
    out, held = [], []
    for piece in [p for p in [parts[0], *[sep + p for p in parts[1:]]] if p]:
        if len(piece) >= size and finer:
            out += ["".join(held).strip(), *split_directly(piece, size, overlap, finer)]
            held = []
            continue
        if held and len("".join(held)) + len(piece) > size:
            out.append("".join(held).strip())
            while held and (len("".join(held)) > overlap or len("".join(held)) + len(piece) > size):
                held.pop(0)
        held.append(piece)
    return [x for x in [*out, "".join(held).strip()] if x]


def test_recursive_chunks_are_those_of_the_rule(spark):
    rng = np.random.default_rng(5)
    bits = ["a", "bb ", "ccc. ", "dd\n", "\n\n", "é漢 ", "😀", "x" * 30, "  ", ". ", "\u3000", "y" * 70, "\x1c", "word "]
    texts = ["".join(bits[int(i)] for i in rng.integers(0, len(bits), int(n))) for n in rng.integers(0, 60, 150)] + ["x" * 1300, "word " * 700, "a" * 500, "a" * 501, ("s. " * 300 + "\n\n") * 3, "q" * 499 + " " + "z" * 500, None]
    for size, overlap in ((500, 50), (40, 10)):
        got = chunks.chunk_recursive(spark.createDataFrame(list(enumerate(texts)), "i int, part string"), "part", size, overlap).orderBy("piece_index").collect()
        for i, t in enumerate(texts):
            assert [r.chunk for r in got if r.i == i] == (split_directly(t, size, overlap) if t else [])


def test_chunks(spark):
    t = ("word " * 30 + ". ") * 30
    split = lambda *texts: [r.chunk for r in chunks.chunk_recursive(spark.createDataFrame([(x,) for x in texts], "part string")).orderBy("piece_index").collect()]
    pieces = split(t)
    assert pieces == split_directly(t) and all(len(p) <= 500 for p in pieces) and all(p in t for p in pieces)
    assert split("x" * 1200)[0] == "x" * 500 and split(None, "", " \n ") == []
    docs = spark.createDataFrame([("d", "k", "s", "u", "t", "body k " * 20 + "\n\n[댓글]\n" + "대출 급전 사채 카톡 " * 5)], "_id string, keyword string, source string, url string, title string, content string")
    rows = chunks.process_documents(docs).collect()
    assert [r.content_type for r in rows] == ["body"] and rows[0].chunk_index == 0 and rows[0].is_relevant
    assert chunks.process_documents(docs.withColumn("content", F.lit(""))).count() == 0


def test_near_duplicates_are_greedy(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today again"
    texts = [base, base.replace("lazy", "tired"), "something else entirely, with other words in it and nothing shared at all", base + "!", base]
    c = spark.createDataFrame([("k", i, i, t) for i, t in enumerate(texts)], "keyword string, seq int, parent_id int, text string")
    kept = []
    for t in texts:
        if not any(difflib.SequenceMatcher(None, t, o).ratio() >= 0.8 for o in kept):
            kept.append(t)
    assert [r.text for r in dedup.drop_near_duplicates(c).orderBy("seq").collect()] == kept
    own = spark.createDataFrame([("k", 0, base)], "keyword string, parent_id int, text string")
    assert {r.seq for r in dedup.drop_near_duplicates(c, own).collect()} == {0, 2}
    other = own.withColumn("parent_id", F.lit(99))
    assert {r.seq for r in dedup.drop_near_duplicates(c, other).collect()} == {2}


def test_unknown_relevance_passes_validity_only(spark):
    df = spark.createDataFrame([("k", None), ("k", True), ("k", False)], "k string, r boolean").withColumn("t", F.lit("k " * 30))
    ok = gates.valid_chunk(F.col("k"), F.lit("https://a.b/c"), F.lit(""), F.col("t"), F.col("r"))
    assert [r.r for r in df.where(ok).collect()] == [None, True]


def test_replace_by_parent(spark):
    p = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "parent_id string, n int")
    out = tables.replace_by_parent(p, p.where("n = 9"), spark.createDataFrame([("a",)], "parent_id string"))
    assert [tuple(r) for r in out.collect()] == [("b", 1)]


def test_reset_needs_a_scope(spark):
    import pytest

    with pytest.raises(ValueError):
        tables.reset_for_reprocessing(spark.createDataFrame([(True, "k")], "is_embedded boolean, keyword string"))


def test_source_cap_fills_up(spark):
    hits = spark.createDataFrame([("q", i, s, i) for i, s in enumerate("aaab", 1)], "query_id string, chunk_id int, source string, rank int")
    assert [r.chunk_id for r in retrieval.topk_with_cap(hits, 3, 1).orderBy("place").collect()] == [1, 4, 2]


def test_metrics(spark):
    g = spark.createDataFrame([("q", "m", "a", 1, 0), ("q", "m", "b", 2, 2)], "query_id string, method string, chunk_id string, rank int, rel int")
    grades = spark.createDataFrame([("q", "b", 2), ("q", "c", 1)], "query_id string, chunk_id string, rel int")
    r = evaluation.per_query(g, grades, 5).first()
    import math

    assert r.precision == 0.2 and r.mrr == 0.5 and abs(r.ndcg - (2 / math.log2(3)) / (2 + 1 / math.log2(3))) < 1e-9


def test_fixture_round_trip(spark, tmp_path):
    rows = [("1", "k", "s", "u", "t", "c", 0.5, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), False)]
    docs = spark.createDataFrame(rows, io.RAW_SCHEMA)
    io.write_fixture(docs, str(tmp_path / "f"))
    assert [tuple(r) for r in io.read_fixture(spark, str(tmp_path / "f")).collect()] == rows
    (tmp_path / "k.txt").write_text(" a \n\n# no\nb\n")
    assert [r.keyword for r in io.read_keywords(spark, str(tmp_path / "k.txt"), comments=True).collect()] == ["a", "b"]


def test_runs_are_appended(spark, tmp_path):
    for i in (1, 2):
        io.append_run(spark.createDataFrame([(i, "c")], "run int, config string"), str(tmp_path / "runs"), f"run {i}")
    assert io.read_runs(spark, str(tmp_path / "runs"), "run int, config string").count() == 2
    io.write_metrics(spark.createDataFrame([("q", 0.5)], "query string, p double"), str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).columns == ["query", "p"]


def stream_of(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def run(query, tmp_path, name, mode="append"):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)


def events(spark):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i % 7, f"kw{i % 3}", start + dt.timedelta(minutes=20 * i)) for i in range(300)], "_id int, keyword string, ts timestamp")


def test_stream_counts_equal_batch_for_closed_days(spark, tmp_path):
    df = events(spark)
    batch = {(r.keyword, r.day): r.value for r in jobs.daily_mentions(df, F.col("keyword"), F.lit("c")).collect()}
    run(jobs.daily_mentions(stream_of(spark, tmp_path, df), F.col("keyword"), F.lit("c"), delay="1 hour"), tmp_path, "daily")
    got = {(r.keyword, r.day): r.value for r in spark.table("daily").collect()}
    assert got and all(batch[k] == v for k, v in got.items()) and max(k[1] for k in got) < max(k[1] for k in batch)


def test_stream_dedup_gate_and_bursts_equal_batch(spark, tmp_path):
    df = events(spark)
    s = stream_of(spark, tmp_path, df)
    run(jobs.first_of_id(s, delay="10 days"), tmp_path, "first")
    assert sorted(r._id for r in spark.table("first").collect()) == list(range(7))
    hidden = spark.createDataFrame([("kw1",)], "keyword string")
    run(jobs.gate_against(s, hidden, ["keyword"]), tmp_path, "gate")
    assert spark.table("gate").count() == 200
    key = lambda x: x.select(F.col("keyword").alias("key"), "ts")
    run(jobs.flag_bursts(key(s), 2, 7200), tmp_path, "bursts")
    want = jobs.flag_bursts(key(df), 2, 7200)
    assert sorted(map(str, spark.table("bursts").collect())) == sorted(map(str, want.collect()))


def test_stream_chunks_equal_batch(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), "k", "s", "u", "t", f"k text number {i} " * 40) for i in range(5)], "_id string, keyword string, source string, url string, title string, content string")
    q = jobs.clean_and_chunk(stream_of(spark, tmp_path, docs), str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = jobs.latest_chunks(spark, str(tmp_path / "out"))
    want = chunks.process_documents(docs)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_stream_replaces_older_versions(spark, tmp_path):
    schema = "_id string, keyword string, source string, url string, title string, content string, crawled_at bigint"
    row = lambda i, text, at: (str(i), "cafe\u0301", "s", "u", "t", f"café {text} {i} " * 40 if text else "", at)
    batches = [[row(1, "old", 1), row(2, "two", 1)], [row(1, "new", 3), row(1, "late", 2), row(3, "three", 2)], [row(2, "", 4)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = jobs.clean_and_chunk(stream, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    want = chunks.process_documents(spark.createDataFrame([row(1, "new", 3), row(3, "three", 2)], schema))
    got = jobs.latest_chunks(spark, str(tmp_path / "out"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert want.where("is_relevant").count() == want.count() > 0  # composed and decomposed forms are one


def _edited(rng, text: str, every: int) -> str:
    """A replacement, insertion or deletion at every so many characters."""
    out = []
    for k, c in enumerate(text):
        kind = rng.integers(3) if k and k % every == 0 else -1
        out.append({-1: c, 0: "#", 1: c + "qzx"[k % 3], 2: ""}[int(kind)])
    return "".join(out).strip()


def _similar(new: str, old: str, threshold: float = 0.8) -> bool:
    return difflib.SequenceMatcher(None, new, old).ratio() >= threshold


def _many_texts():
    """Windows of a keyword's documents and short texts, edits spread over them evenly and locally, letters of a large alphabet."""
    rng = np.random.default_rng(3)
    con = duckdb.connect()
    found = [t for (t,) in con.sql("select text from '/root/testdata/sf0.001/documents.parquet' where doc_id % 6 = 2 order by doc_id").fetchall() if t]
    texts = [t[i : i + n].strip() for t in found for i, n in ((0, 500), (450, 500), (100, 250), (30, 120), (10, 45))][:60]
    hangul = ["".join(chr(0xAC00 + int(x)) for x in rng.integers(0, 900, n)) for n in (500, 480, 190, 60)]
    base = [*texts[:26], *hangul, "ab" * 250, "a" * 300, "abc " * 30]
    texts += hangul + [_edited(rng, t, every) for t in base for every in (3, 6, 7, 30) if len(t) > 20]
    for t in base:
        at, size = int(rng.integers(0, max(1, len(t) - 9))), int(rng.integers(0, len(t) // 4 + 1))
        texts += [(t[:at] + "qz" + t[at + size :]).strip(), (t[:at] + t[: size + 2] + t[at:]).strip()]
    return list(dict.fromkeys(t for t in texts if t))


def test_near_duplicates_lose_no_pair(spark, monkeypatch):
    """Against all pairs of a keyword, of many lengths; in one block a class and in many."""
    texts = _many_texts()
    want = {(i, j) for j, b in enumerate(texts) for i, a in enumerate(texts[:j]) if _similar(b, a)}
    spread = {(i, j) for i, j in want if len(texts[i]) > 250 and len(dedup_grams(texts[i], 6) & dedup_grams(texts[j], 6)) < 100}
    assert len(want) > 150 and len(spread) > 5
    df = spark.createDataFrame([("k", i, i, t) for i, t in enumerate(texts)] + [("other", len(texts), 0, texts[0]), ("k", -1, 0, None), ("k", -2, 0, "")], "keyword string, seq bigint, parent_id bigint, text string")
    assert {(r.earlier, r.later) for r in dedup.similar_pairs(df).collect()} == want
    tried = candidates.candidate_pairs(df.withColumn("known", F.lit(False)), 0.8).count()
    assert len(want) <= tried <= 20 * len(want)
    monkeypatch.setattr(candidates, "BLOCK", 7)
    assert {(r.earlier, r.later) for r in dedup.similar_pairs(df).collect()} == want
    low = {(i, j) for j, b in enumerate(texts[:80]) for i, a in enumerate(texts[:j]) if _similar(b, a, 0.5)}
    assert {(r.earlier, r.later) for r in dedup.similar_pairs(df.where("seq < 80"), 0.5).collect()} == low


def dedup_grams(t: str, q: int) -> set[str]:
    return {t[i : i + q] for i in range(len(t) - q + 1)}


def test_common_grams_brute():
    """The index counts the different grams that texts have in common, from `since` on; a floor of the bound is never over it."""
    texts = [t for t in _many_texts() if len(t) > 12][:70]
    new, old = texts[:40], texts[25:]
    joined = lambda ts: (candidates.code_points("".join(ts)), np.array([len(t) for t in ts]))
    since = np.arange(len(old)) % 30
    for q in candidates.GRAMS:
        a, b = candidates.grams(*joined(new), q), candidates.grams(*joined(old), q)
        keys, repeats = candidates.different(a, len(new))
        assert repeats.tolist() == [len(t) - q + 1 - len(dedup_grams(t, q)) for t in new]
        own, _ = candidates.different(candidates.also_in(b, keys), len(old))
        parts = list(candidates.common_grams(keys, own, since, np.arange(len(old)), len(new)))
        got = np.vstack([m for _, m in parts])
        assert np.concatenate([k for k, _ in parts]).tolist() == list(range(len(old)))
        assert got.tolist() == [[len(dedup_grams(x, q) & dedup_grams(y, q)) if i >= since[k] else 0 for i, x in enumerate(new)] for k, y in enumerate(old)]
    total = np.arange(2, 3000)
    for threshold in (0.5, 0.8, 0.9):
        for begins in (-1, 0, 7, 40, 400):
            assert all((candidates.surely_common(total, threshold, begins, q) <= candidates.least_common(total, threshold, begins, q)).all() for q in candidates.GRAMS)
            q = candidates.gram_lengths(total, np.full(len(total), begins), threshold)
            assert all((candidates.least_common(np.arange(n, 2 * n), threshold, begins, k) >= 1).all() for n, k in zip(total[:300], q))


def test_near_duplicates_with_existing_are_greedy(spark):
    """Kept rows are those of the rule in order, also against existing texts, but for those of the same parent."""
    texts = _many_texts()[::2]
    order = np.random.default_rng(9).permutation(len(texts))
    old = [(int(k) % 9, texts[k]) for k in order[:40]]
    new = [(n, int(k) % 9, texts[k]) for n, k in enumerate(order[20:])]
    kept = []
    for n, parent, t in new:
        if not any(p != parent and _similar(t, o) for p, o in old) and not any(_similar(t, o) for _, o in kept):
            kept.append((n, t))
    chunk_rows = spark.createDataFrame([("k", n, p, f" {t}\n") for n, p, t in new], "keyword string, seq int, parent_id int, text string")
    existing = spark.createDataFrame([("k", p, t) for p, t in old] + [("z", 77, new[0][2])], "keyword string, parent_id int, text string").repartition(3)
    assert {r.seq for r in dedup.drop_near_duplicates(chunk_rows, existing).collect()} == {n for n, _ in kept}
    assert dedup.drop_near_duplicates(chunk_rows.limit(0), existing).count() == 0
    assert dedup.drop_near_duplicates(chunk_rows, existing.limit(0)).count() == dedup.drop_near_duplicates(chunk_rows).count()


def test_near_duplicates_in_rounds_write_few_pairs(spark, monkeypatch):
    """Many near copies of a text: in blocks of 8 the rows are those of the rule, no round writes pairs of all copies, and no text leaves a cell."""
    rng = np.random.default_rng(17)
    base = dedup_words(rng, 25)
    rows = []
    for n in range(120):
        words = list(base)
        words[int(rng.integers(0, 25))] = f"n{n}"
        rows.append(("k" if n % 4 else "other", 10 * n, n % 5, " ".join(words) if n % 6 else f"{n} " + " ".join(dedup_words(rng, 20))))
    old = [("k", 3, rows[1][3])]
    kept = []
    for k, n, parent, t in rows:
        if not any(k == o and parent != p and _similar(t, x) for o, p, x in old) and not any(k == o and _similar(t, x) for o, x in kept):
            kept.append((k, t))
    monkeypatch.setattr(candidates, "BLOCK", 8)
    sizes, plans, checkpoint = [], [], dedup.checkpoint

    def noted(df):
        out = checkpoint(df)
        if "later" in df.columns:
            sizes.append(out.count())
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(dedup, "checkpoint", noted)
    chunk_rows = spark.createDataFrame(rows, "keyword string, seq int, parent_id int, text string").repartition(3)
    got = dedup.drop_near_duplicates(chunk_rows, spark.createDataFrame(old, "keyword string, parent_id int, text string")).collect()
    assert [(r.keyword, r.text) for r in sorted(got, key=lambda r: r.seq)] == kept and 20 < len(kept) < 40
    assert max(sizes) <= 2 * (8 * 7 // 2 + 8 * len(kept)) and not any("text" in p.split("FlatMapGroupsInPandas")[0] for p in plans)


def dedup_words(rng, n: int) -> list[str]:
    return ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6)) for _ in range(n)]


def test_bounds_of_candidates():
    """May-be checks never turn down a pair that reaches the threshold; common subsequences are those of the table."""
    texts = _many_texts()
    rng = np.random.default_rng(4)
    some = rng.integers(0, len(texts), (300, 2))
    assert all(dedup.may_be_similar(texts[i], texts[j], 0.8) for i, j in some if _similar(texts[i], texts[j]))

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    a, b = [t for t in texts if len(t) < 290][:25], [t for t in texts if len(t) < 250][-25:]
    i, j = (x.ravel() for x in np.meshgrid(range(len(a)), range(len(b))))
    assert candidates.common_subsequences(a, b, i, j).tolist() == [lcs(a[x], b[y]) for x, y in zip(i, j)]


def test_cross_df_of_a_long_list_is_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "xx kw1 yy"), ("b", "kw1kw2"), ("b", "k"), ("c", ""), ("c", "가나다 kw2")], "keyword string, norm string")
    words = spark.createDataFrame([("a", "kw1"), ("b", "kw2"), ("c", "k"), ("d", "가나"), ("e", "")], "keyword string, norm string")
    short = sorted(map(str, tables.cross_df(docs, words).collect()))
    monkeypatch.setattr(tables, "LISTED", 0)
    assert sorted(map(str, tables.cross_df(docs, words).collect())) == short
    many = spark.createDataFrame([(f"k{i % 7}", f"text of k{i % 40} and k{i % 13}") for i in range(300)] + [("k1", None), ("k2", "k3"), ("k2", "k3")], "keyword string, norm string")
    listed = spark.createDataFrame([(f"k{i}", f"k{i}") for i in range(45)] + [("own", "of")], "keyword string, norm string")
    long = sorted(map(str, tables.cross_df(many, listed).collect()))
    monkeypatch.undo()
    assert sorted(map(str, tables.cross_df(many, listed).collect())) == long


def test_headings_of_an_answer(spark):
    answer = "\n**1) 의미**: \n 첫째다. \n\n## 2. 유행  이유\n둘째요 [자료 1]\n3. 사용법\n셋째임\n### 4. **확인된 사용맥락**\n넷째!\n\n"
    unified = "### 1. 의미\n\n첫째다.\n\n### 2. 유행 이유\n\n둘째요 [자료 1]\n\n### 3. 사용법\n\n셋째임\n\n### 4. 확인된 사용 맥락\n\n넷째!"
    get = lambda t: value(spark, text.unify_headings(F.col("t")), t=t)
    assert get(answer) == unified and get(unified) == unified
    assert get(answer + "#### 5) 트렌드맥락:\n\t식었다. ") == unified + "\n\n### 5. 트렌드 맥락\n\n식었다."
    assert get(answer + "5. 트렌드 맥락\n식었 그리고") is None and get(answer.replace("셋째임", "셋째")) is None and get(answer.replace("3.", "2.")) is None
    assert get("") is None and value(spark, text.unify_headings(F.lit(None).cast("string")), t="x") is None


def test_dates_by_source(spark):
    df = spark.createDataFrame([(1, "2024.1.5 10:20", "x"), (2, "soon", "x"), (3, "soon", "y"), (4, "soon", None), (5, "24/01/05", "x")], "i bigint, raw string, source string")
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    assert sorted(r.i for r in gates.dated(df, "raw", "at", now, dropping=("x",)).collect()) == [1, 3, 4, 5]
    assert gates.dated(df, "raw", "at", now).count() == 5


def test_entities(spark):
    raw = "&amp;lt; &eacute; &#9733; &copy &nbsp;|&quot;&#39;&gt;"
    assert value(spark, text.unescape_all(F.col("t")), t=raw) == html.unescape(raw)
    assert value(spark, text.unescape_all(F.col("t")), t="a &lt;b&gt; &amp; c") == "a <b> & c"


def test_dense_topk_of_blocks_and_parts(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 4)).round(1)
    v[7] = 0
    v[9] = v[8]
    chunks_ = spark.createDataFrame([(i, f"k{i % 3}", v[i].tolist()) for i in range(60)] + [(60, "k0", None)], "chunk_id bigint, keyword string, vec array<double>")
    asked = chunks_.where("chunk_id % 10 = 7 or chunk_id = 8").select(F.col("chunk_id").cast("string").alias("query_id"), "keyword", "vec")
    plain = {}
    for q in (8, 17, 27, 37, 47, 57):
        for within in (None, "keyword"):
            ids = [i for i in range(60) if i != 7 and (not within or i % 3 == q % 3)]
            cos = {i: round(float(v[i] @ v[q] / np.linalg.norm(v[i]) / np.linalg.norm(v[q])), 9) for i in ids}
            plain[q, within] = sorted(ids, key=lambda i: (-cos[i], i))[:5]
    for size, parts in ((16 << 20, 1), (4 * 8 * 2, 7)):
        for within in (None, "keyword"):
            got = {}
            for r in sorted(retrieval.dense_topk(asked, chunks_.repartition(parts), 5, within, size).collect(), key=lambda r: r["rank"]):
                got.setdefault((int(r.query_id), within), []).append(r.chunk_id)
            assert got == {k: x for k, x in plain.items() if k[1] == within}


def test_dense_search_in_blocks_of_queries(spark):
    """Any number of query blocks and parts gives the same: ties by id, keys, null and zero vectors, fewer chunks than k."""
    rng = np.random.default_rng(6)
    vecs = [[float(x) for x in rng.integers(-2, 3, 3)] for _ in range(400)]
    rows = [(f"c{i:03d}", f"k{i % 3}", None if i % 41 == 0 else v) for i, v in enumerate(vecs)]
    asks = [(i, f"k{i % 4}", None if i == 9 else v) for i, v in enumerate(vecs[:40])]
    c = spark.createDataFrame(rows, "chunk_id string, keyword string, vec array<float>").repartition(5)
    q = spark.createDataFrame(asks, "query_id int, keyword string, vec array<double>")

    def brute(within):
        out = set()
        for qi, qk, qv in asks:
            if qv is None or not any(qv):
                continue
            scored = sorted((-round(float(np.dot(qv, v) / (np.linalg.norm(qv) * np.linalg.norm(v))), 9), i) for i, k, v in rows if v and any(v) and (not within or k == qk))
            out |= {(qi, i, r + 1) for r, (_, i) in enumerate(scored[:7])}
        return out

    for within in (None, "keyword"):
        for size in (16 << 20, 24 * 7):
            got = retrieval.dense_topk(q, c, 7, within, size)
            assert {(r.query_id, r.chunk_id, r["rank"]) for r in got.collect()} == brute(within)
    plan = retrieval.dense_topk(q, c, 7)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and retrieval.dense_topk(q.limit(0), c, 7).count() == retrieval.dense_topk(q, c.limit(0), 7).count() == 0


def test_global_positions(spark):
    rng = np.random.default_rng(8)
    values = [None if x == 7 else int(x) for x in rng.integers(0, 50, 500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v int").repartition(6)
    got = {r.id: r.place for r in numbered(df, [F.desc_nulls_last("v"), F.col("id")], "place").collect()}
    order = sorted(range(500), key=lambda i: (values[i] is None, -(values[i] or 0), i))
    assert [got[i] for i in order] == list(range(1, 501))
    assert numbered(df.limit(0), [F.col("id")], "place").count() == 0
    # no window over all rows, which one task would sort
    for ranked in (numbered(df, [F.col("v"), F.col("id")], "place"), evaluation.paired_bootstrap(df.select(F.col("id").alias("query_id"), F.coalesce("v", F.lit(0)).alias("diff")), 10)):
        assert "Window" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_in_blocks(spark):
    d = spark.createDataFrame([(i, float(i * i % 17) - 7) for i in range(101)], "query_id int, diff double")
    one, many = (evaluation.paired_bootstrap(d, 60, block=n).first() for n in (1000, 9))
    assert one.n == 101 and all(abs(a - b) < 1e-9 if isinstance(a, float) else a == b for a, b in zip(one, many))
    assert evaluation.paired_bootstrap(d.limit(0), 20).first().n == 0


def test_burst_state_goes_and_late_rows(spark, tmp_path):
    """Timers remove the state of keys whose hits can't count any more; a late row counts the accepted hits before it only."""
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    batches = [[(f"k{i}", at(0, i)) for i in range(20)], [("late", at(5)), ("z", at(5))], [("late", at(4, 55)), ("late", at(5, 1)), ("z", at(5, 2)), ("k1", at(0, 2))], [("z", at(12))], [("z", at(13))]]
    schema = "key string, ts timestamp"
    seen = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.flag_bursts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 1, 600, delay="10 minutes")
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        seen.append([p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators][-1])
    assert seen[0] == 20 and seen[-1] <= 1
    got = {(r.key, r.ts): r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["late", at(5)] and got["late", at(4, 55)] and not got["late", at(5, 1)] and not got["z", at(5, 2)]
    assert ("k1", at(0, 2)) not in got  # later than the delay


def test_stream_store_counts_what_is_committed(spark, tmp_path):
    """A folder without its line in the manifest doesn't count, repeats change nothing, compaction keeps what counts and is read instead."""
    schema = "_id string, keyword string, source string, url string, title string, content string"
    row = lambda i, text: (str(i), "k", "s", "u", "t", f"k {text} {i} " * 40 if text else "")
    out = str(tmp_path)
    rows = lambda df: sorted((r.parent_id, r.chunk_index, r.chunk) for r in df.collect())
    batch = lambda *r: spark.createDataFrame(list(r), schema)
    jobs.commit_chunks(batch(row(1, "one"), row(2, "two")), 0, out)
    jobs.commit_chunks(batch(row(2, "new"), row(3, "three")), 1, out)
    want = rows(chunks.process_documents(batch(row(1, "one"), row(2, "new"), row(3, "three"))))
    assert rows(jobs.latest_chunks(spark, out)) == want
    chunks.process_documents(batch(row(1, "torn"))).write.parquet(f"{out}/data/epoch=2")  # no line in the manifest yet
    jobs.commit_chunks(batch(row(2, "new"), row(3, "three")), 1, out)
    assert rows(jobs.latest_chunks(spark, out)) == want
    jobs.compact_chunks(spark, out)
    assert [e for e, _ in jobs.committed(spark, out)] == [1] and rows(jobs.latest_chunks(spark, out)) == want
    jobs.commit_chunks(batch(row(1, "")), 2, out)
    jobs.commit_chunks(batch(row(1, "again")), 0, out)  # a replay from before the compaction
    assert rows(jobs.latest_chunks(spark, out)) == [r for r in want if r[0] != "1"]
    jobs.compact_chunks(spark, out)
    assert len(jobs.committed(spark, out)) == 1 and rows(jobs.latest_chunks(spark, out)) == [r for r in want if r[0] != "1"]


def test_runs_are_appended_once(spark, tmp_path):
    run = spark.createDataFrame([("c", 1.0)], "config string, score double")
    for run_id in ("a/1", "b", "a/1"):
        io.append_run(run, str(tmp_path / "r"), run_id)
    assert sorted(r.run_id for r in io.read_runs(spark, str(tmp_path / "r"), "config string, score double").collect()) == ["a/1", "b"]


def test_facets_with_near_duplicates(spark):
    """The merge in order, with a ratio of its own: longest common blocks, left and right of each other."""

    def matched(a, b):
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        return n + matched(a[:i], b[:j]) + matched(a[i + n :], b[j + n :]) if n else 0

    rng = np.random.default_rng(2)
    base = ["the quick brown fox jumps", "an older grey dog sleeps", "seven red kites fly high"]
    rows = [("k", f, r, f"facet{f}", int(i), f"s{int(i) % 3}", base[int(i) % 3] + "!?. "[int(i) % 4] * int(i) if i % 5 else f"text {i} of its own, {i * 7919}") for f in range(4) for r, i in enumerate(rng.permutation(14)[:7])]
    hits = spark.createDataFrame(rows, "keyword string, facet_no int, rank int, facet string, chunk_id int, source string, text string")
    first = {}
    for _, f, r, _, i, source, t in sorted(rows, key=lambda x: (x[1], x[2])):
        first.setdefault(i, (source, t.strip()))
    kept, later, counts = [], [], {}
    similar = lambda t: any(2 * matched(t, o) / (len(t) + len(o)) >= 0.8 for _, o, _ in kept)
    for i, (source, t) in first.items():
        if similar(t):
            continue
        if counts.get(source, 0) >= 2:
            later.append((i, t))
        else:
            counts[source] = counts.get(source, 0) + 1
            kept.append((i, t, False))
    for i, t in later:
        if len(kept) < 5 and not similar(t):
            kept.append((i, t, True))
    got = retrieval.merge_facets(hits, cap=2, least=5, near=0.8).orderBy("place").collect()
    assert [(r.chunk_id, r.deferred) for r in got] == [(i, d) for i, _, d in kept]


def test_sparse_topk_is_exact_without_a_token_join(spark):
    """Against all pairs, ties by id: frequent tokens, weights of both signs, many blocks of queries and small matrices; no join."""
    rng = np.random.default_rng(11)
    rows = [(i, "ab"[i % 2], f"t{int(t)}", float(rng.integers(-1, 4) or 2)) for i in range(90) for t in set(rng.zipf(1.3, 1 + i % 40) % 50)] + [(91, "a", None, 1.0), (92, None, "t1", 1.0), (93, "a", "t1", None)]
    postings = spark.createDataFrame(rows, "chunk_id bigint, keyword string, token string, weight double")
    queries = postings.where("chunk_id % 4 = 0").select(F.concat(F.lit("q"), "chunk_id").alias("query_id"), "keyword", "token", "weight")
    for within in (None, "keyword"):
        scores = {}
        for q, qk, qt, qw in rows:
            for c, ck, ct, cw in rows:
                if q % 4 == 0 and qt is not None and qt == ct and (not within or (qk is not None and qk == ck)) and qw is not None and cw is not None:
                    scores.setdefault(f"q{q}", {}).setdefault(c, 0.0)
                    scores[f"q{q}"][c] += qw * cw
        want = {(q, c, s, n) for q, found in scores.items() for n, (c, s) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:7], 1)}
        for size, cells in ((1 << 20, 1 << 20), (400, 30)):
            got = retrieval.sparse_topk(queries, postings.repartition(3), 7, within, size, cells)
            assert {tuple(r) for r in got.collect()} == want
            assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_sparse_topk_of_tokens_that_no_open_query_has(spark):
    """Once q0 is through, the next chunks hold only tokens that none of the other queries has."""
    queries = spark.createDataFrame([("q0", "k", "x", 1.0), ("q1", "k", "y", 1.0)], "query_id string, keyword string, token string, weight double")
    rows = [(i, "k", "x", 20.0 - i) for i in range(10)] + [(10, "k", "y", 2.0), (11, "k", "y", 1.0)]
    postings = spark.createDataFrame(rows, "chunk_id bigint, keyword string, token string, weight double").coalesce(1)
    got = retrieval.sparse_topk(queries, postings, 1, None, cells=1).orderBy("query_id").collect()
    assert [tuple(r) for r in got] == [("q0", 0, 20.0, 1), ("q1", 10, 2.0, 1)]


def test_grades_are_made_for_asked_pairs_only(spark):
    """Grades of the results and of the ideals are those of all pairs of a keyword, but no more rows than these need."""
    queries = spark.createDataFrame([(f"q{i}", "ab"[i % 2]) for i in range(6)] + [("z", None)], "query_id string, keyword string")
    chunk_grades = spark.createDataFrame([(i, "ab"[i % 2] if i != 5 else None, i * 7 % 3) for i in range(40)], "chunk_id int, keyword string, rel int")
    every = queries.join(chunk_grades, "keyword").select("query_id", "chunk_id", "rel")
    ranked = spark.createDataFrame([(f"q{i}", m, (i + 3 * r) % 9, r) for i in range(6) for m in ("x", "y") for r in (1, 2, 3)], "query_id string, method string, chunk_id int, rank int")
    asked, best = evaluation.grades_of(ranked, queries, chunk_grades), evaluation.best_grades(queries, chunk_grades, 5)
    assert asked.count() <= 18 and best.count() == 30
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(evaluation.grade_results(ranked, asked)) == rows(evaluation.grade_results(ranked, every))
    assert rows(evaluation.per_query(evaluation.grade_results(ranked, asked), best, 5)) == rows(evaluation.per_query(evaluation.grade_results(ranked, every), every, 5))


def test_plain_texts_do_not_reach_python(spark, monkeypatch):
    """Latin-1 and Hangul are folded by Spark, alike; other letters by Python."""

    @F.pandas_udf("string")
    def none_expected(texts: pd.Series) -> pd.Series:
        assert texts.isna().all()
        return texts

    plain = ["", "ASCII Only ~", "".join(map(chr, range(1, 256))), "가나다 Straße µ ÀÉ", "힣\U000000ff"]
    odd = ["é ŉ ſ İ", "ΑΣ", "각", "각ᆨ", "\U0001f600A"]
    want = lambda t: unicodedata.normalize("NFC", t).casefold()
    assert [value(spark, text.fold(F.col("t")), t=t) for t in plain + odd] == [want(t) for t in plain + odd]
    monkeypatch.setattr(text, "nfc_fold", none_expected)
    assert [value(spark, text.fold(F.col("t")), t=t) for t in plain] == [want(t) for t in plain]


def test_cleaning_tries_patterns_where_they_can_match(spark):
    """The same as all patterns on all texts, where one makes what the next one matches."""
    def plain(c):
        c = F.coalesce(text.unescape(c), F.lit(""))
        c = F.replace(F.regexp_replace(c, "<[^>]+>", " "), F.lit("\xa0"), F.lit(" "))
        for pattern, new in ((text.URL, ""), (text.EMAIL, "[EMAIL]"), (text.PHONE, "[PHONE]"), (r"(.)\1{3,}", "$1$1$1")):
            c = F.regexp_replace(c, pattern, new)
        for phrase in text.BOILERPLATE:
            c = F.replace(c, F.lit(phrase), F.lit(" "))
        c = F.regexp_replace(F.regexp_replace(c, "[ \t]{2,}", " "), "\n{3,}", "\n\n")
        return F.trim(F.array_join(F.transform(F.split(c, "\n"), lambda x: F.trim(x, F.lit(" \t\r\x0b\x0c"))), "\n"), F.lit(" \t\r\n\x0b\x0c"))

    rng = random.Random(5)
    parts = ["dc official App", "카페 ", "게시글", "이웃추가", "URL복사", "a@b.co", "@", "www.", "http", "://x.y/z", "010-1234-5678", "0", " ", "\t", "\n", "\n\n", "<b>", "<", ">", "&lt;", "&amp;", "&eacute;", "oooo", "é", "\xa0", "<i>w</i>ww.q"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 12)))) for i in range(600)] + [(600, None)]
    both = spark.createDataFrame(rows, "i int, t string").select("i", text.clean_text(F.col("t")).alias("a"), plain(F.col("t")).alias("b"))
    assert both.where("not a <=> b").collect() == []


def test_points_are_encoded_in_bounded_calls(spark):
    """A call has no more texts and bytes than allowed, however large the batch; every row gets its own values."""

    def encoder(texts):
        assert len(texts) <= 5 and (len(texts) == 1 or sum(len(t.encode()) for t in texts if t) <= 40)
        return [[float(len(t or ""))] for t in texts], [{1: float(len(t or ""))} if t != "" else {} for t in texts]

    rows = [(i, None if i == 7 else "é" * (i % 13 * (9 if i == 25 else 1)), ["a", str(i)]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, encoding_text string, tags array<string>").coalesce(1)
    got = retrieval.build_points(df, encoder, 5, 40).orderBy("doc_id").collect()
    assert [(r.doc_id, r.tags, r.dense, r.sparse) for r in got] == [(i, g, [float(len(t or ""))], {1: float(len(t or ""))} if t != "" else {}) for i, t, g in rows]
    assert got[0].__fields__ == ["doc_id", "tags", "dense", "sparse"]


def test_sentence_ends_are_told_from_last_characters(spark):
    """As over the whole text, also where a citation is cut, or nothing but spaces, quotes and citations is left."""
    rng = np.random.default_rng(8)
    ends = [".", "다", "x", "자료", "료 1]", "[자료 2]", "[", "]", " ", "\n", "\r", "\u2028", "\u0085", "”)", "7", "a b", "[자료 " + "1" * 300 + "]", "[자료" + " " * 280 + "3]", " " * 300, "*" * 256]
    texts = ["".join(ends[k] for k in rng.integers(0, len(ends), rng.integers(1, 6))) for _ in range(1500)]
    texts += ["a. " + "b" * n + e for n in (0, 250, 255, 256, 400) for e in ends] + ["", "다" + "[자료 1]" * 90, "x" + "[자료 1]" * 90, None]
    t = F.col("t")
    plain = F.rlike(F.regexp_replace(t, text.CITATION, ""), F.lit(text.SENTENCE_END))
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", plain.alias("want"), text.whole_sentence(t).alias("got")).collect()
    assert [r.t for r in rows if r.want != r.got] == [] and {r.want for r in rows} == {True, False, None}
