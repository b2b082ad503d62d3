"""Training-data operators against brute force, held-out accuracy and edge cases."""

import hashlib
import itertools
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trendspark.llm import (
    common, decontaminate, line_dedup, mixing, ngram_join, quality_classifier, quality_rules, suffix_dedup, textvec, toxicity, url_filter,
)

DATA = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPLIT = re.compile(r"[\x20\x09-\x0D]+")
tokens = lambda t: [w for w in SPLIT.split(t or "") if w]


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOC)


def clash(df):
    """Extra columns with names that operators use."""
    return df.withColumns({"n_lines": F.lit("x"), "key": F.lit(1), "keeper": F.lit(1), "component": F.lit(2), "kept": F.lit("y"), "rate": F.lit(0), "__w": F.lit(0)})


ODD = [None, "", " \n\t", "one", "one", "one two three four five six seven", "ß É ñ 漢字 😀 " * 3, "x" * 200_000, "a b c d e f g h " * 20_000]

# ------------------------------------------------------------------ line dedup


def brute_lines(rows, least_chars=20, least_docs=3):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    have = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars and d is not None:
                have[key(x)].add(d)
    gone = {k: max(v) for k, v in have.items() if len(v) >= least_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or gone.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_brute(spark):
    line, other = "A common line of text, long enough", "another line that is long enough too"
    rows = [(1, line), (2, f"{line.upper()}  \nshort"), (3, f"x\n\t{line}\n{line}"), (3, line), (4, other), (5, other), (6, None), (7, ""), (None, line), (8, "É" + line), (9, "é" + line)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted([tuple(r) for r in line_dedup.line_dedup(df).select("doc_id", "n_lines", "n_dropped", "text").collect()], key=str)
    assert got == brute_lines(rows)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_odd_texts_and_names(spark):
    out = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.line_dedup(clash(docs(spark, ODD))).collect()}
    assert out == {d: (n, gone, t) for d, n, gone, t in brute_lines(list(enumerate(ODD)))}
    # three copies of the odd texts: long lines stay in the last one alone
    rows = list(enumerate(ODD * 3))
    got = [tuple(r) for r in line_dedup.line_dedup(clash(docs(spark, ODD * 3))).select("doc_id", "n_lines", "n_dropped", "text").collect()]
    assert sorted(got, key=str) == brute_lines(rows)


def test_line_dedup_is_linear_in_dropped_lines(spark):
    def seconds(n):
        lines = [f"a common line with the number {i} in it" for i in range(n)]
        df = docs(spark, ["\n".join(lines), "\n".join(reversed(lines)), "\n".join(lines + ["own"])])
        began = time.time()
        out = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.line_dedup(df).collect()}
        assert [out[i][0] for i in range(3)] == [n, n, 0] and out[0][1] == "" and out[2][1].endswith("own")
        return time.time() - began

    seconds(100)
    assert seconds(20_000) < 4 * seconds(5_000) + 1


def test_line_dedup_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = line_dedup.query(spark, DATA)
    want = con.sql(line_dedup.ORACLE)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())


# ------------------------------------------------------------------ suffix dedup


def test_interval_expansion():
    rng = np.random.default_rng(1)
    for _ in range(30):
        t = np.append(rng.integers(0, 3, rng.integers(1, 150)), 99)
        order = suffix_dedup.bounded_order(t, 7)
        got = suffix_dedup.common_prefixes(t, order, 7)
        for i in range(1, len(order)):
            a, b = t[order[i - 1] :], t[order[i] :]
            n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert got[i] == (n if n < 7 else -1)


def brute_spans(rows, size=50):
    texts = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in texts:
        if d is not None:
            for i in range(len(b) - size + 1):
                first[b[i : i + size]] = min(first.get(b[i : i + size], d), d)
    out = []
    for d, b in texts:
        c = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1) if d is not None else ():
            if first[b[i : i + size]] < d:
                c[i : i + size] = True
        runs = int((np.diff(np.r_[0, c.astype(int), 0]) == 1).sum())
        out.append((d, len(b), int(c.sum()), runs, bytes(x for x, y in zip(b, c) if not y)))
    return sorted(out, key=str)


def spans(df):
    out = []
    for r in suffix_dedup.repeated_spans(df).collect():
        out.append((r.doc_id, r.n_bytes, sum(e - s for s, e in zip(r.starts, r.ends)), len(r.starts), bytes(r.kept)))
    return sorted(out, key=str)


def test_suffix_dedup_brute(spark):
    rng = np.random.default_rng(2)
    word = lambda n: " ".join("".join(rng.choice(list("abcde"), 6)) for _ in range(n))
    shared, rows = [word(20) for _ in range(4)], []
    for i in range(60):
        rows.append((int(i * 7 % 61), word(10) + str(rng.choice(shared))[rng.integers(0, 30) : rng.integers(60, 140)] + word(5) + ("é" * 30 if i % 5 == 0 else "")))
    rows += [(100, shared[0]), (101, shared[0]), (101, shared[0]), (None, shared[0]), (102, None), (103, ""), (104, "z" * 300), (105, "z" * 120 + "é" * 40), (106, shared[0][:50]), (107, shared[0][:49]), (108, shared[0] + "\n" + shared[1])]
    assert spans(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute_spans(rows)


def test_suffix_dedup_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 4)  # nearly all anchors of a passage
    monkeypatch.setattr(suffix_dedup, "LEAST_BATCH_BYTES", 700)
    rng = np.random.default_rng(12)
    word = lambda n: " ".join("".join(rng.choice(list("abcde"), 6)) for _ in range(n))
    line, ends = word(6), [word(3) for _ in range(4)]
    rows = [(int(i * 5 % 83), word(8) + str(rng.choice(ends)) + line[: rng.integers(33, 42)] + str(rng.choice(ends)) + word(8)) for i in range(80)]
    assert spans(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute_spans(rows)


def test_suffix_dedup_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in common.table(spark, DATA, "documents").collect()]
    got = sorted(tuple(r) for r in suffix_dedup.query(spark, DATA).collect())
    assert got == sorted((d, n, k, s, hashlib.sha256(b).hexdigest()) for d, n, k, s, b in brute_spans(rows))


def test_suffix_dedup_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 3)
    rng = np.random.default_rng(5)
    rows = np.zeros(40, suffix_dedup._record(18))
    rows["gram"], rows["key"], rows["doc"] = rng.integers(0, 5, 40), np.arange(40), rng.integers(0, 9, 40)
    rows["a"], rows["b"] = 18, 18
    rows["left"], rows["right"] = rng.integers(97, 99, (40, 18)), rng.integers(97, 99, (40, 18))
    bits = suffix_dedup._verdicts(rows, 18)
    for i, r in enumerate(rows):
        for s in range(19):
            window = lambda x: (x["gram"], tuple(x["left"][s:]), tuple(x["right"][:s]))
            assert bool(bits[i] >> s & 1) == any(window(x) == window(r) and x["doc"] < r["doc"] for x in rows)


def test_suffix_dedup_odd_texts(spark):
    got = {r.doc_id: (r.n_bytes, list(r.starts), list(r.ends), bytes(r.kept)) for r in suffix_dedup.repeated_spans(clash(docs(spark, ODD))).collect()}
    # repeats inside one document are no matches
    assert got == {i: (len((t or "").encode()), [], [], (t or "").encode()) for i, t in enumerate(ODD)}
    twice = suffix_dedup.repeated_spans(docs(spark, ODD + ODD[-2:])).collect()
    want = {i: (0 if i >= len(ODD) else len((t or "").encode())) for i, t in enumerate(ODD + ODD[-2:])}
    assert {r.doc_id: len(r.kept) for r in twice} == want
    assert suffix_dedup.repeated_spans(docs(spark, ["x"]).limit(0)).count() == 0


# ------------------------------------------------------------------ url filter

PAGES = "page_id bigint, url string, html string"


def verdicts(spark, pages, rules=url_filter.RULES):
    df = spark.createDataFrame(pages, PAGES)
    return {r.page_id: (r.rule, r.verdict) for r in url_filter.url_verdicts(df.select("page_id", "url"), url_filter.link_edges(df), rules).collect()}


def canonical(u):
    return f'<head><link rel="canonical" href="{u}"></head>'


def test_url_components(spark):
    rules = (("block", "bad.org", "/"), ("allow", "bad.org", "/ok/"), ("allow", "good.org", "/"))
    pages = [
        (1, "http://a.net/1", canonical("http://x.bad.org/p")), (2, "http://a.net/2", canonical("http://a.net/1")), (3, "http://a.net/3", "<link href='http://a.net/2' rel='canonical'>"),
        (4, "http://bad.org/ok/1", canonical("http://bad.org/2")), (5, "http://b.net/1", '<meta http-equiv="refresh" content="0; url=http://good.org/x">'), (6, "http://b.net/2", canonical("/1")),
        (7, "http://c.net/1", canonical("http://bad.org/ok/9")), (8, "http://c.net/2", canonical("http://bad.org/3?q")), (9, "http://c.net/2#top", canonical("http://c.net/1")), (10, None, None), (11, "no scheme", "x"),
        (12, "http://BAD.org", ""), (13, "http://notbad.org/", ""), (13, "http://notbad.org/", ""),
    ]
    got = verdicts(spark, pages, rules)
    assert [got[i][1] for i in (1, 2, 3)] == ["block"] * 3
    assert got[4] == ("bad.org/ok/", "allow") and got[5][1] == got[6][1] == "allow"
    assert got[7][1] == got[8][1] == got[9][1] == "allow"  # an explicit allow in the component
    assert got[10] == (None, "allow") and got[11] == (None, "allow") and got[12] == (None, "allow") and got[13] == (None, "allow")
    assert verdicts(spark, [], rules) == {}


def test_url_clashing_names(spark):
    """Names that the operator uses are the caller's as well; host, path, rule and verdict are replaced."""
    pages = [(1, "http://a.net/1", canonical("http://bad.org/p")), (2, "http://BAD.org/q?x", None), (3, None, "")]
    df = spark.createDataFrame(pages, PAGES)
    names = ("said", "node", "row", "own", "component", "__node", "__own", "v")
    extra = df.withColumns({c: F.concat(F.lit(c), "page_id") for c in (*names, "host", "path", "rule", "verdict")})
    got = {r.page_id: r for r in url_filter.url_verdicts(extra, url_filter.link_edges(extra), (("block", "bad.org", "/"),)).collect()}
    assert all(got[i][c] == f"{c}{i}" for i in got for c in names)
    assert {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()} == {
        1: ("a.net", "/1", None, "block"), 2: ("bad.org", "/q", "bad.org/", "block"), 3: ("", "", None, "allow"),
    }


def test_url_sql_with_links(spark, tmp_path):
    rng = np.random.default_rng(3)
    hosts = ["a.example.org", "b.example.com", "c.example.net"]
    urls = [f"http://{hosts[i % 3]}/{'es' if i % 4 == 0 else 'de' if i % 4 == 1 else 'en'}/{i}" for i in range(60)]
    pages = [(i, u, canonical(urls[rng.integers(0, 60)]) if i % 2 else "") for i, u in enumerate(urls)]
    spark.createDataFrame(pages, PAGES).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(url_filter.ORACLE)
    got = url_filter.query(spark, str(tmp_path))
    assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5300)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for a, b in edges for x in (a, b) if a != b or x in got}


# ------------------------------------------------------------------ quality rules


def brute_counts(t):
    w = tokens(t)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in (t or "").split("\n") if tokens(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_brute(spark):
    rows = [(r.doc_id, r.text) for r in common.table(spark, DATA, "documents").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD[:7] + ["a b c d e f g h " * 3, "w " * 50, "x y \x1c z", "l\nl\n \nl m\nl"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in quality_rules.text_counts(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {d: brute_counts(t) for d, t in rows}


def regular(points, floors, n, factor):
    """Covariance as the operator defines it: least variances, and correlations that shrink by n / (n + p)."""
    c = np.cov(points.T, bias=True) * factor
    out = c * n / (n + len(c))
    np.fill_diagonal(out, np.maximum(np.diag(c), floors))
    return out


def consistent(share, p):
    share = 0.5 + np.floor((share - 0.5) * 200 + 0.5) / 200
    return 1.0 if share >= 1 else share / quality_rules.chi2_cdf(quality_rules.chi2_quantile(share, p), p + 2)


def subset_rows(n, p):
    half = min((n + p + 1) // 2, n)
    return int(2 * half - n + 2 * (n - half) * quality_rules.SUBSET)


def brute_mcd(x):
    """Enumerate all subsets, take the one of least determinant, reweight once: (log determinant in units of the scales, distances)."""
    n, p = x.shape
    h = subset_rows(n, p)
    q = lambda c, a: (np.floor(np.sort(c)[int(np.ceil(a * n)) - 1] * 1024) + 0.5) / 1024
    med, scale = np.array([q(c, 0.5) for c in x.T]), np.array([max((q(c, 0.75) - q(c, 0.25)) / 1.349, 1e-4) for c in x.T])
    u, floors = (x - med) / scale, 1e-8 / scale**2
    best = min(itertools.combinations(range(n), h), key=lambda s: np.linalg.slogdet(regular(u[list(s)], floors, n, consistent(h / n, p)))[1])
    m, s = u[list(best)].mean(0), regular(u[list(best)], floors, n, consistent(h / n, p))
    least = np.linalg.slogdet(s)[1]
    dist = lambda: np.einsum("ij,ij->i", (u - m) @ np.linalg.inv(s), u - m)
    near = u[dist() <= quality_rules.chi2_quantile(0.975, p)]
    m, s = near.mean(0), regular(near, floors, n, 0.975 / quality_rules.chi2_cdf(quality_rules.chi2_quantile(0.975, p), p + 2))
    return least, dist()


def mcd_rows(spark, rows, min_group):
    """(lang, source, statistics) rows -> model and d2 by row number."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n bigint, lang string, source string, " + ", ".join(f"{c} double" for c in quality_rules.FLOORS))
    model = quality_rules.fit_mcd(df, ["lang", "source"], min_group=min_group)
    return model, {r.n: r.d2 for r in quality_rules.mcd_distances(df, model, ["lang", "source"]).collect()}


def test_mcd_finds_the_least_determinant(spark):
    rng = np.random.default_rng(6)
    p, rows = len(quality_rules.FLOORS), []
    for g in range(4):
        x = rng.normal(size=(18, p)) @ rng.normal(size=(p, p)) + 5
        x[:2] += 60  # far outliers
        rows += [("en", f"s{g}", *map(float, v)) for v in x]
    model, got = mcd_rows(spark, rows, min_group=10)
    least = {r.g_1: r.mcd_logdet for r in model.collect()}
    for g in range(4):
        want, d2 = brute_mcd(np.array([r[2:] for r in rows[18 * g : 18 * g + 18]]))
        assert least[f"s{g}"] == pytest.approx(want, abs=0.02)
        np.testing.assert_allclose([got[i] for i in range(18 * g, 18 * g + 18)], d2, rtol=0.02)
        assert min(got[18 * g], got[18 * g + 1]) > 40


def test_mcd_pools_and_judges_every_row(spark):
    rng = np.random.default_rng(6)
    rows = []
    for lang, source, n in (("en", "a", 300), ("en", "b", 130), ("de", "a", 30), ("de", None, 40), ("de", "c", 50), (None, "c", 5)):
        rows += [(lang, source, *map(float, v)) for v in rng.normal(size=(n, len(quality_rules.FLOORS))) * (1 + (rng.random((n, 1)) < 0.1) * 8)]
    model, got = mcd_rows(spark, rows, min_group=100)
    key = {(r.g_0, r.g_1): r["__key"] for r in model.collect()}
    assert key["de", "a"] == key["de", None] == key["de", "c"] and len(set(key.values())) == 4
    assert all(got[i] is not None for i in range(len(rows)))
    out = np.array([got[i] for i in range(300)])
    big = np.abs(np.array([r[2:] for r in rows[:300]])).max(1) > 7
    assert out[big].min() > 40 and np.median(out[~big]) < 8


def test_mcd_survives_a_masking_cluster(spark):
    rng = np.random.default_rng(16)
    x = rng.normal(size=(400, len(quality_rules.FLOORS)))
    x[:80] = 6 + rng.normal(size=(80, x.shape[1])) * 0.05  # a tight cluster that plain covariances hide
    _, got = mcd_rows(spark, [("en", "a", *map(float, v)) for v in x], min_group=100)
    assert min(got[i] for i in range(80)) > 60 and np.median([got[i] for i in range(80, 400)]) < 8


def test_quality_rules_keep_the_clean(spark):
    out = quality_rules.query(spark, SMALL).toPandas().merge(pd.read_parquet(f"{SMALL}/labels.parquet"), on="doc_id")
    clean = out[(out.quality == 1) & (out.n_words >= 20)]
    assert clean.kept.mean() > 0.98 and out[out.quality == 0].kept.mean() < 0.6


def test_mcd_floors_change_no_larger_variance(spark):
    rng = np.random.default_rng(7)
    dims = list(quality_rules.FLOORS)
    x = rng.normal(size=(300, len(dims))) * 0.02
    x[:, 2] = 0  # constant but for one row
    x[0, 2] = 0.05
    df = spark.createDataFrame([(i, "en", "a", *map(float, v)) for i, v in enumerate(x)], "id bigint, lang string, source string, " + ", ".join(f"{c} double" for c in dims))
    model = quality_rules.fit_mcd(df, ["lang", "source"], noise={c: F.lit(0.01) for c in dims})
    got = {r.id: r.d2 for r in quality_rules.mcd_distances(df, model, ["lang", "source"]).collect()}
    rest = np.delete(x, 2, 1)
    plain = np.einsum("ij,ij->i", (rest - rest.mean(0)) @ np.linalg.inv(np.cov(rest.T)), rest - rest.mean(0))
    assert np.median([got[i] for i in range(1, 300)]) == pytest.approx(np.median(plain[1:]), rel=0.15)  # not held down by a constant
    assert got[0] > 24  # five times the noise


def test_quality_rules_drop_light_symbol_junk(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 9)))
    clean = [" ".join(word() for _ in range(n)) for n in rng.integers(60, 400, 300)]
    junk = [" | ".join(word() for _ in range(n)) for n in rng.integers(60, 400, 15)]
    one = [clean[0] + " |"]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs(spark, clean + junk + one)).collect()}
    assert sum(not kept[i] for i in range(300)) <= 3 and not any(kept[i] for i in range(300, 315)) and kept[315]


def test_quality_rules_kept_poor_and_dropped_good(spark):
    out = quality_rules.query(spark, SMALL).toPandas().merge(pd.read_parquet(f"{SMALL}/labels.parquet"), on="doc_id")
    out = out[~out.base_failed]
    poor, good = out[out.quality == 0], out[out.quality == 1]
    print(f"kept poor {poor.kept.sum()} of {len(poor)}, dropped good {(~good.kept).sum()} of {len(good)}")
    assert poor.kept.mean() < 0.15 and (~good.kept).mean() < 0.02


def test_quality_rules_edges(spark):
    odd = clash(docs(spark, ODD)).withColumn("lang", F.lit(None).cast("string")).withColumns({"g_0": F.lit(1), "q_0": F.lit("z"), "u_0": F.lit(2), "n": F.lit(3)})
    out = {r.doc_id: r for r in quality_rules.judge(odd).collect()}
    assert len(out) == len(ODD) and [out[i].n_words for i in (0, 1, 2, 5)] == [0, 0, 0, 7] and not any(r.kept for r in out.values() if r.n_words < 20)
    assert out[8].base_failed and out[8].d2 is None and out[0].q_0 == "z"
    good = " ".join(f"word{i}" for i in range(40))
    same = {r.doc_id: r.kept for r in quality_rules.judge(docs(spark, [good, good, good])).collect()}  # fewer rows than statistics, all equal
    assert same == {0: True, 1: True, 2: True}
    assert quality_rules.judge(docs(spark, ["x"]).limit(0)).count() == 0


def test_chi2():
    assert quality_rules.chi2_cdf(3.841459, 1) == pytest.approx(0.95, abs=1e-6) and quality_rules.chi2_quantile(0.99, 6) == pytest.approx(16.81189, abs=1e-4)


# ------------------------------------------------------------------ n-gram join


def shingle_set(t):
    w = tokens(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_join(rows, threshold=0.8):
    sets = {d: shingle_set(t) for d, t in rows}
    parent, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, root(d), links[d]) for d in ids)


def joined(df):
    return sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.jaccard_join(df).collect())


def near_copies(n, seed=7):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    out = []
    for i in range(n):
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 5)):
            w[k] = f"x{rng.integers(0, 50)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_join_brute(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_copies(60) + [(100, "a b c"), (101, "a b c"), (102, "a b d"), (103, None), (104, " \n"), (105, "")]
    rows += [(200 + i, " ".join(f"y{k}" for k in range(i, i + 100))) for i in range(0, 60, 6)]
    assert joined(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute_join(rows)


def brute_rows(rows, threshold=0.8):
    """As brute_join, for rows that may share ids: (id, class, links) of each row."""
    found = {i: (root, n) for i, root, n in brute_join(list(enumerate(t for _, t in rows)), threshold)}
    first = {}
    for i, (d, _) in enumerate(rows):
        first[found[i][0]] = min(first.get(found[i][0], d), d)
    return sorted((d, first[found[i][0]], found[i][1]) for i, (d, _) in enumerate(rows))


def test_join_shared_ids_and_ties(spark):
    a = near_copies(9, 21)
    b, c = near_copies(6, 22), near_copies(4, 23)
    rows = [(1, a[0][1]), (1, b[0][1]), (2, a[1][1]), (3, b[1][1]), (4, c[0][1])]
    rows += [(1, c[1][1]), (1, c[2][1]), (5, c[3][1]), (5, c[3][1]), (2, a[2][1]), (2, a[2][1]), (6, a[3][1]), (6, b[2][1]), (7, a[3][1]), (8, "one two"), (8, "one two"), (9, "one two")]
    got = joined(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got == brute_rows(rows) and any(n for _, _, n in got)


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_join_recall_on_the_table(spark, threshold):
    rows = [(r.doc_id, r.text) for r in common.table(spark, DATA, "documents").collect()] + near_copies(60, 31)
    rows += [(10_000 + 10 * k + i, " ".join(f"z{k}_{j}" for j in range(i * step, i * step + 80))) for k, step in enumerate(range(1, 14)) for i in range(3)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    want = {d: n for d, _, n in brute_join(rows, threshold)}
    got = {r.doc_id: r.n_links for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"), threshold).collect()}
    assert sum(got.values()) >= 0.98 * sum(want.values()) and all(got[d] <= want[d] for d in want)


def test_join_of_texts_has_one_plan_at_all_sizes(spark, monkeypatch):
    """Places small enough for a broadcast aren't broadcast, so that the texts' shuffle doesn't begin at some size only."""
    plans = []

    def noted(df, *into):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.checkpoint(df, *into)

    monkeypatch.setattr(ngram_join, "checkpoint", noted)
    rows = [(i, " ".join(f"w{i % 5 * 30 + j}" for j in range(20)) + f" end{i % 2}") for i in range(20)]
    ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).count()
    [verified] = [p for p in plans if "FlatMapGroupsInPandas" in p]
    assert "SortMergeJoin" in verified and "BroadcastHashJoin" not in verified


def test_join_edges(spark):
    out = ngram_join.jaccard_join(clash(docs(spark, ODD, [5, 5, None, 1, 2, 3, 4, 6, 7]))).collect()
    assert sorted(((r.doc_id, r.copy_of, r.class_id, r.n_links) for r in out), key=str) == sorted(
        [(5, 5, 5, 0), (5, 5, 5, 0), (None, None, None, 0), (1, 1, 1, 1), (2, 1, 1, 1), (3, 3, 3, 0), (4, 4, 4, 0), (6, 6, 6, 0), (7, 7, 7, 0)], key=str)
    assert ngram_join.jaccard_join(docs(spark, ["x"]).limit(0)).count() == 0


def test_prefix_is_shortened_to_the_measured_recall():
    depth, all_at = ngram_join.prefix_depth, lambda k: {i: [0] * k + [5] + [0] * (ngram_join.DEPTH - k) for i in range(30)}
    assert depth(all_at(8), 0.8) == 8 and depth(all_at(5), 0.8) == 5 and depth(all_at(0) | {0: [0, 9] + [0] * 7}, 0.8, 0.0) == 8
    assert ngram_join.expected_recall(0.8, depth({}, 0.8)) >= ngram_join.RECALL > ngram_join.expected_recall(0.8, depth({}, 0.8) + 1)
    with pytest.raises(ValueError):
        depth({}, 0.1)


def test_sampled_links_are_exact():
    texts = [t.encode() for _, t in near_copies(40, 5)] + [b"", b"one two", b"one two"]
    sample = ngram_join.Sample(texts[:12], 0.8)
    *keys, (doc, value) = ngram_join.signatures(texts)
    a, k, depth = sample.links(keys[0], keys[1], keys[3], doc, value)
    sets = [shingle_set(t.decode()) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(12) if sets[i] and sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert set(zip(a.tolist(), k.tolist())) == want and 0 <= depth.min() and depth.max() <= ngram_join.DEPTH


def test_join_does_not_depend_on_a_sample(spark, monkeypatch):
    """Pairs at the threshold are found though every document that a sample may hold has near copies only, for which whole labels would do."""
    monkeypatch.setattr(ngram_join, "SAMPLE_BYTES", 400)
    near = [(2 * k + j, " ".join([f"n{k}_{i}" for i in range(50)] + [f"end{j}"])) for k in range(60) for j in (0, 1)]
    edge = [(10_000 + 2 * k + j, " ".join(f"e{k}_{i}" for i in range(20 * j, 184 + 20 * j))) for k in range(400) for j in (0, 1)]
    df = spark.createDataFrame(near + edge, "doc_id bigint, text string")
    assert ngram_join.prefix_depth(ngram_join.sampled_links(df, 0.8), 0.8) == ngram_join.DEPTH
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_join(df).collect()}
    assert got == {d: (d // 2 * 2, 1) for d, _ in near + edge}
    monkeypatch.setattr(ngram_join, "sample_sets", None)
    assert ngram_join.jaccard_join(df.limit(9)).count() == 9


def test_sample_is_hashed_in_tasks(spark, monkeypatch):
    texts = [t for _, t in near_copies(30, 6)] + ["", " ", None, "one two", "one two"]
    given = docs(spark, texts)
    there = ngram_join.Sample.of_rows(ngram_join.sample_sets(given), 0.8)
    here = ngram_join.Sample([t.encode() for t in texts if t is not None], 0.8)  # null texts are not drawn
    order = lambda s: sorted((h, n, d.tobytes(), sorted(s.value[s.doc == i].tolist())) for i, (h, n, d) in enumerate(zip(s.h1.tolist(), s.size.tolist(), s.digits)))
    assert order(there) == order(here)

    def no(*_):
        raise AssertionError("the driver hashes texts")

    monkeypatch.setattr(textvec, "prefix_hash", no)  # workers import their own
    assert ngram_join.jaccard_join(given).count() == len(texts)


def test_loops_count_as_they_write(spark):
    out, n = common.counted(spark.range(100).repartition(7), "id % 3 = 0")
    assert n == 34 and out.count() == 100
    assert common.counted(spark.range(0))[1] == 0 and common.counted(spark.range(9).where("id > 10").distinct())[1] == 0
    sc = spark.sparkContext
    sc.setJobGroup("components", "")
    try:
        common.connected_components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long").where("a > 5"))
        jobs = len(sc.statusTracker().getJobIdsForGroup("components"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 2  # the links' shuffle and their table, which is empty; no job that asks


# ------------------------------------------------------------------ decontamination


def edit_distance_within(window, text):
    row = list(range(len(window) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, w in enumerate(window, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_decontamination_brute(spark):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefg"), rng.integers(2, 8))) for _ in range(n))
    items = [(i, word(int(rng.integers(8, 40)))) for i in range(12)]
    texts = []
    for i in range(80):
        t = items[i % 12][1]
        chars = list(t)
        for k in rng.integers(0, len(chars), rng.integers(0, int(len(chars) * 0.09) + 1)):
            chars[k] = rng.choice(["", "q", chars[k] + "q"])
        texts.append(word(30) + " " + ("".join(chars).upper() if i % 2 else "".join(chars).replace(" ", "\n ")) + " " + word(30))
    texts += [word(60) for _ in range(20)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    index = decontaminate.Index(items)
    want = set()
    for d, t in enumerate(texts):
        codes = decontaminate.normalise(t).tolist()
        for w, e, item in zip(index.codes, index.errors, index.item):
            if edit_distance_within(w.tolist(), codes) <= e:
                want.add((d, item))
    assert got == want and len(want) > 40


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "a passage that is long enough to be looked for"), (None, "x" * 50)], "item_id bigint, text string")
    rows = clash(docs(spark, ["A  passage that is LONG enough\nto be looked for", None, "", "clean text", "A passage that is long enough to be looked for"], [1, 2, 3, 4, None]))
    assert sorted(str(r.doc_id) for r in decontaminate.find_leaks(rows, bench).collect()) == ["1", "None"]
    assert sorted(str(r.doc_id) for r in decontaminate.decontaminate(rows, bench).collect()) == ["2", "3", "4", "None"]
    assert decontaminate.find_leaks(rows, bench.limit(0)).count() == 0 and decontaminate.find_leaks(rows.limit(0), bench).count() == 0
    assert decontaminate.find_leaks(docs(spark, ODD), bench).count() == 0


# ------------------------------------------------------------------ classifiers


def test_word_hashes_follow_words():
    texts = [b"", b"  ", b"a bc a", "é\tbc\n".encode(), b"x" * 70_000]
    w = textvec.Words(texts)
    assert w.count.tolist() == [0, 0, 3, 2, 1] and w.hash[0] == w.hash[2] and w.hash[1] == w.hash[4] and len(set(w.hash.tolist())) == 4


def test_quality_classifier_held_out(spark):
    out = quality_classifier.query(spark, SMALL).toPandas()
    assert len(out) == 1000 and all(out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]) and out.score.between(0, 1).all()
    h = out[out.held_out].merge(pd.read_parquet(f"{SMALL}/labels.parquet"), on="doc_id")
    good, bad = h[h.quality == 1].score.to_numpy(), h[h.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() > 0.97


def test_factorisation_identity():
    rng = np.random.default_rng(9)
    fm = quality_classifier.FactorisationMachine()
    f, x = rng.choice(1000, 12, replace=False), rng.random(12).astype(np.float32)
    z = fm.logits(np.zeros(12, int), f, x)[0][0]
    pairs = sum(float(fm.v[f[i]] @ fm.v[f[j]]) * x[i] * x[j] for i in range(12) for j in range(i))
    assert z == pytest.approx(pairs, abs=1e-5)


def test_toxicity_gradient():
    m = toxicity.BiGru()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x = toxicity.Inputs([b"some words here and there", b"other words, fewer"])
    loss = lambda: float((m.forward(m.gates(x)[0].astype(np.float64), x.windows)[0] * [1.0, -0.5]).sum())
    g, vec = m.gates(x)
    _, cache = m.forward(g, x.windows, keep=True)
    grad = m.backward(x, x.windows, vec, cache, np.array([1.0, -0.5]))
    for name, at in (("wx", (0, 3)), ("uf", (1, 2)), ("ub", (2, 20)), ("att", (3,)), ("out", (9,)), ("word", (x.bucket[0], 1)), ("char", (x.char[0, 0], 2))):
        old, eps = m.p[name][at], 0.02
        m.p[name][at] = old + eps
        up = loss()
        m.p[name][at] = old - eps
        down = loss()
        m.p[name][at] = old
        assert grad[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=2e-4)


def test_toxicity_windows_cover_every_word():
    text = " ".join(f"w{i}" for i in range(500)).encode()
    x = toxicity.Inputs([b"", text, b"one"])
    assert x.owner.tolist()[0] == 0 and x.owner.tolist()[-1] == 2
    seen = {int(i) for i in x.windows[x.owner == 1].ravel()} - {len(x.bucket)}
    assert len(seen) == 500 and (np.bincount(x.owner)[1] - 1) * toxicity.STRIDE + toxicity.WINDOW >= 500


def test_toxicity_learns_and_generalises():
    rng = np.random.default_rng(10)
    word = lambda: "".join(rng.choice(["an", "er", "on", "ti", "ou", "ed"], rng.integers(1, 4)))
    bad = ["awful", "nasty", "zorkle"]
    make = lambda toxic: " ".join([word() for _ in range(rng.integers(5, 300))] + ([str(rng.choice(bad))] if toxic else []) + [word() for _ in range(30)]).encode()
    y = np.array([i % 2 for i in range(400)], float)
    m = toxicity.BiGru().fit([make(k) for k in y], y, epochs=4)
    test = np.array([i % 2 for i in range(100)])
    p = m.scores([make(k) for k in test])
    assert ((p >= 0.5) == test).mean() > 0.95


def test_classifier_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (3, None, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    df = clash(docs(spark, ODD, [1, 1, 2, None, 3, 4, 5, 6, 7]))
    for labels in (none, one):
        model = quality_classifier.fit(df, labels)
        out = quality_classifier.score(df, model).toPandas()
        assert len(out) == len(ODD) and out.score.between(0, 1).all()
        assert quality_classifier.score(df.limit(0), model).count() == 0
        assert out[out.doc_id.isna()].score.item() == out[(out.doc_id == 3)].score.item()  # equal texts
        out = toxicity.score(df, toxicity.fit(df, labels)).toPandas()
        assert len(out) == len(ODD) and out.score.between(0, 1).all()
    assert toxicity.score(df.limit(0), toxicity.fit(df, none)).count() == 0


# ------------------------------------------------------------------ mixing


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(11)
    p = rng.dirichlet([0.5, 0.4, 0.3], 400)
    df = spark.createDataFrame([(i, int(n), *map(float, q)) for i, (n, q) in enumerate(zip(rng.integers(0, 500, 400), p))], "doc_id bigint, n_tokens bigint, p_a double, p_b double, p_c double")
    out = mixing.fit_rates(df, {"a": 0.5, "b": 0.2, "c": 0.3}).toPandas()
    total = out.n_tokens.sum()
    got = [(out.n_tokens * out.rate * out[f"p_{k}"]).sum() / total for k in "abc"]
    assert np.abs(np.array(got) - [0.5, 0.2, 0.3]).max() < 2e-3 and out.rate.min() >= 0
    assert mixing.fit_rates(df.limit(0), {"a": 1.0, "b": 1.0, "c": 1.0}).count() == 0


def test_rates_solve_the_least_squares_problem():
    rng = np.random.default_rng(12)
    p, n = rng.dirichlet([1, 1], 60), rng.integers(1, 50, 60)
    want, history = np.array([0.9, 0.1]), np.zeros((0, 2))
    for _ in range(3000):
        _, ahead = mixing.rates_of(p, history)
        e = ((n * ahead) @ p) / n.sum() - want
        history = np.vstack([history, e])
        if len(history) >= 400:
            break
    r, _ = mixing.rates_of(p, history)
    e = ((n * r) @ p) / n.sum() - want
    slope = p @ e + mixing.STAY * (r - 1)  # zero where the rate is over 0, not negative where it is 0
    assert np.abs(slope[r > 1e-6]).max() < 1e-4 and slope[r <= 1e-6].min(initial=0) > -1e-4


def test_mixing_edges(spark):
    df = clash(docs(spark, ODD))
    labels = mixing.label_domains(spark.createDataFrame([(5, 1, 0), (6, 0, 0), (7, None, None)], "doc_id bigint, quality int, toxic int"))
    out = mixing.mixing_rates(df, labels).toPandas()
    assert len(out) == len(ODD) and (out.rate >= 0).all() and np.allclose(out[["p_good", "p_poor", "p_toxic"]].sum(axis=1), 1)
    assert out[out.doc_id.isin([3, 4])].rate.nunique() == 1  # equal texts
    assert mixing.mixing_rates(df.limit(0), labels).count() == 0
    assert mixing.mixing_rates(df, labels.limit(0)).count() == len(ODD)
