from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat_format, decontaminate, fill_in_middle, linear_ngrams, packing, parity_join, quality_model, quality_rules, queries, suffix_dedup, token_count, toxicity, url_filter
from tessera.llm.suffix_array import suffix_array
from tests.compare import connection, same
from tests.llm import brute

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def none_of(spark, df):
    return df.limit(0)


# SQL


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, data, name):
    same(queries.QUERIES[name](spark, data), queries.SQL[name], connection(data))


# Packing


def check_packed(rows, texts, library, end_id=1, most=2048):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, t in texts:
        ids = [*ids_of(library, t), end_id]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= most
    return {k: sum(r["length"] for r in v) for k, v in sequences.items()}, sequences


def test_packing_holds_every_id_once(spark, messy, messy_df, library):
    rows = queries.packed(messy_df.repartition(3)).collect()
    totals, _ = check_packed(rows, messy, library)
    assert all(n == 2048 or n & (n - 1) == 0 for n in totals.values())  # no padding at all
    assert queries.packed(none_of(spark, messy_df)).count() == 0


def test_packing_keeps_three_limits(spark, library):
    rows = spark.createDataFrame([(i, "an answer of some words " * (i % 5 + 1), "a prompt " * (i % 7)) for i in range(60)], "doc_id long, text string, prompt string").coalesce(1)
    out = packing.pack(rows, queries.tokenizer("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256}, prompt="prompt", limits=(64, 3, 40)).collect()
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        assert sum(r["length"] for r in own) <= 64 and len(own) <= 3 and sum(r["n_loss"] for r in own) <= 40
    want = sum(len(ids_of(library, f"{r['text']}")) + 1 for r in rows.collect())
    assert sum(r["n_loss"] for r in out) == want


def test_packing_takes_odd_rows(spark, library):
    text = "some words of a text " * 90
    rows = [(1, text, "a prompt", 5), (1, text, "a prompt", 5), (2, None, None, 5), (None, "", "only a prompt " * 900, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt string, length long").coalesce(1)
    ranks, special = queries.tokenizer("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256}
    out = packing.pack(df, ranks, special, prompt="prompt", limits=(512, 4, 300)).collect()
    ids = {1: len(ids_of(library, text)) + 1, 2: 1}
    prompt = {1: len(ids_of(library, "a prompt")), None: len(ids_of(library, "only a prompt " * 900)), 2: 0}
    total = {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        assert r["length"] <= 512 and r["n_loss"] <= 300
    assert total == {1: 2 * (ids[1] + prompt[1]), 2: 1, None: prompt[None] + 1}
    assert packing.pack(df.limit(0), ranks, special, prompt="prompt").count() == 0
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append(r)
    assert all(sum(r["length"] for r in own) <= 512 and len(own) <= 4 and sum(r["n_loss"] for r in own) <= 300 for own in by.values())


def test_packing_fills_as_well_as_first_fit(spark, library):
    """The share of padding is no more than that of first-fit decreasing on the same examples, under the same limits."""
    rng = np.random.default_rng(3)
    rows = [(i, "word " * int(rng.integers(1, 400)), "ask " * int(rng.integers(0, 200))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt string").coalesce(1)
    limits = (512, 6, 320)
    out = packing.pack(df, queries.tokenizer("byte_bpe_50k.tiktoken"), {}, prompt="prompt", limits=limits).collect()
    demands = sorted(([len(ids_of(library, p)) + (n := len(ids_of(library, t)) + 1), 1, n] for _, t, p in rows), reverse=True)
    bins = []
    for d in (d for d in demands if d[0] <= limits[0] and d[2] <= limits[2]):
        room = next((b for b in bins if all(x + y <= z for x, y, z in zip(b, d, limits))), None)
        if room is None:
            bins.append(list(d))
        else:
            room[:] = [x + y for x, y in zip(room, d)]
    size = {}
    for r in out:
        size[r["sequence_id"]] = size.get(r["sequence_id"], 0) + r["length"]
    padded = lambda n: 0 if n & (n - 1) == 0 else 512 - n
    share = sum(padded(n) for n in size.values()) / sum(size.values())
    assert share <= sum(512 - b[0] for b in bins) / sum(b[0] for b in bins)


# URL filters


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        (None, "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("https://WWW.Example.COM/en/a?x#y", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        ("http://example.com/en", "example.com", "/en", "com/", "allow"),
        ("http://example.com", "example.com", "", None, "allow"),
        ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
        ("http://a.net/ES/1", "a.net", "/ES/1", None, "allow"),
        ("http://a.net#/es/", "a.net", "", None, "allow"),
        ("http://notcom/", "notcom", "/", None, "allow"),
        ("http://a://b.com/x", "a:", "//b.com/x", None, "allow"),
    ],
)
def test_url_filter(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "clash")], "page_id long, url string, host string")
    for most in (url_filter.MOST_BROADCAST, 0):  # broadcast, and joined
        row = url_filter.filter_urls(df, most_broadcast=most).first()
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, rule, verdict)


def test_url_filter_takes_partial_segments_and_empty_tables(spark):
    trie = url_filter.RuleTrie([("block", "a.b/x/ya"), ("allow", "b"), ("allow", "a.b/x//z")])
    assert trie.match("c.a.b", "/x/yard") == ("a.b/x/ya", "block")
    assert trie.match("c.a.b", "/x/y") == ("b", "allow") and trie.match("a.b", "/x//zz") == ("a.b/x//z", "allow")
    assert url_filter.filter_urls(spark.createDataFrame([], "url string")).count() == 0
    with pytest.raises(ValueError):
        url_filter.filter_urls(spark.createDataFrame([], "url string"), [("deny", "a/")])


def test_url_filter_takes_repeated_rows_long_urls_and_equal_patterns(spark):
    long = "http://" + "a." * 3000 + "b/" + "x/" * 20_000
    df = spark.createDataFrame([(1, long), (1, long), (2, "http://c.b/x"), (2, "http://c.b/x")], "page_id long, url string")
    for most in (url_filter.MOST_BROADCAST, 0):
        rows = url_filter.filter_urls(df, [("block", "b/x/x"), ("allow", "b/x/x"), ("allow", "c.b/"), ("block", "c.b/")], most_broadcast=most).collect()
        assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in rows) == [(1, "b/x/x", "block")] * 2 + [(2, "c.b/", "allow")] * 2


# Classifiers


@pytest.mark.parametrize("module, name, label, least", [(toxicity, "score_toxicity", "toxic", 0.85), (quality_model, "score_quality", "quality", 0.9)])
def test_classifiers_hold_out(spark, module, name, label, least):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = getattr(module, name)(docs, labels)
    rows = scored.join(labels, "doc_id").filter("held_out").select("score", "predicted", label).collect()
    pos, neg = ([r["score"] for r in rows if r[label] == c] for c in (1, 0))
    auc = np.mean([[1.0 * (p > q) + 0.5 * (p == q) for q in neg] for p in pos])
    assert auc >= least and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


@pytest.mark.parametrize("module, name, label", [(toxicity, "score_toxicity", "toxic"), (quality_model, "score_quality", "quality")])
def test_classifiers_take_odd_rows(spark, messy_df, module, name, label):
    f = getattr(module, name)
    labels = messy_df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias(label)).unionByName(spark.createDataFrame([(None, 1), (10, None)], f"doc_id long, {label} int"))
    docs = messy_df.withColumn("score", F.lit("clash")).unionByName(messy_df.withColumn("score", F.lit("clash")))
    rows = f(docs, labels).collect()
    assert len(rows) == 2 * messy_df.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({(r["doc_id"], r["score"]) for r in rows}) == messy_df.count()
    one = f(messy_df, labels.filter(f"{label} = 1")).select("score").distinct().collect()
    assert len(one) == 1 and one[0]["score"] > 0.5
    with pytest.raises(ValueError):
        f(messy_df, labels.limit(0))


def test_selected_ngrams_match_brute_force(spark):
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("abé日 "), rng.integers(0, 60))) + ("zzß" if k % 2 and k % 7 else "") for k in range(800)]
    rows = spark.createDataFrame([(t, k % 2) for k, t in enumerate(texts)], "text string, label int").repartition(3)
    counts = {}
    for k, t in enumerate(texts):
        grams = {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
        for b in {int(linear_ngrams.gram_buckets(linear_ngrams.code_points(g, False), len(g))[0]) for g in grams}:
            counts.setdefault(b, [0, 0])[k % 2] += 1
    want = {}
    for b, (n0, n1) in counts.items():
        p0, p1 = (n0 + 0.5) / 401, (n1 + 0.5) / 401
        error = (1 / (n0 + 0.5) - 1 / 401 + 1 / (n1 + 0.5) - 1 / 401) ** 0.5
        if abs(np.log(p1 / p0)) > 4 * error:
            want[b] = np.log(p1 / p0)
    buckets, ratios = linear_ngrams.select(rows, (1, 3), False)
    assert want and buckets.tolist() == sorted(want) and np.allclose(ratios, [want[b] for b in sorted(want)])


def test_long_texts_are_parted_without_loss(monkeypatch):
    texts = ["", "ab", "abcdefgh" * 40 + "xyz", "q" * 90, "", "é日本" * 30]
    found = [sorted(f.tolist()) for f in linear_ngrams.Indicators((1, 4), True)(texts)]
    monkeypatch.setattr(linear_ngrams, "CHUNK", 50)
    assert [sorted(f.tolist()) for f in linear_ngrams.Indicators((1, 4), True)(texts)] == found
    assert found == [sorted({int(linear_ngrams.gram_buckets(linear_ngrams.code_points(t[i : i + n], True), n)[0]) for n in range(1, 5) for i in range(len(t) - n + 1)}) for t in texts]


def test_linear_models_are_optimal():
    rng = np.random.default_rng(10)
    n, k = 60, 12
    x = rng.normal(size=(n, k)) * (rng.random((n, k)) < 0.5)
    label = (x @ rng.normal(size=k) + rng.normal(size=n) > 0).astype(int)
    row, feature = np.nonzero(x)
    weight = np.where(label == 1, 0.7, 1.3)
    w, bias = toxicity.logistic(row, feature, x[row, feature], label, k, weight, ridge=0.5)

    def loss(v):
        return weight @ np.logaddexp(0, -(2 * label - 1) * (x @ v[:-1] + v[-1])) + 0.25 * v[:-1] @ v[:-1]

    best = loss(np.append(w, bias))
    assert all(loss(np.append(w, bias) + step) >= best - 1e-6 for step in rng.normal(size=(300, k + 1)) * rng.choice([1e-3, 0.1, 1], (300, 1)))
    # hinge loss: the dual's value is the primal's
    sign, cost = 2.0 * label - 1, np.full(n, 0.5)
    rows = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in x]
    w = quality_model.dual_descent(rows, sign, cost, k, passes=3000)
    ones = np.column_stack((x, np.ones(n)))
    primal = lambda v: 0.5 * v @ v + cost @ np.maximum(0, 1 - sign * (ones @ v))
    assert all(primal(w + step) >= primal(w) - 1e-2 for step in rng.normal(size=(300, k + 1)) * rng.choice([1e-3, 0.1, 1], (300, 1)))


@pytest.mark.parametrize("module, name, label", [(toxicity, "score_toxicity", "toxic"), (quality_model, "score_quality", "quality")])
def test_classifiers_take_empty_tables_and_long_texts(spark, messy_df, module, name, label):
    f = getattr(module, name)
    labels = messy_df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias(label))
    long_one = messy_df.filter("doc_id = 33").withColumn("text", F.repeat("text", 30))
    rows = f(messy_df.unionByName(long_one), labels).filter("doc_id = 33").select("score").collect()
    assert len(rows) == 2
    none = f(messy_df.limit(0), labels)
    assert none.count() == 0 and {"held_out", "score", "predicted"} <= set(none.columns)
    with pytest.raises(ValueError):
        f(messy_df, labels.limit(0))


def test_labels_of_held_out_rows_are_never_learnt_from(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(linear_ngrams.held_out("doc_id", 4, 2), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score_toxicity(docs, x).select("doc_id", "score").orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


# Suffix sorting and repeats


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(symbols):
    s = [*symbols, 0]
    assert suffix_array(np.array(s)) == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeats_match_brute_force(spark, messy, messy_df):
    want = brute.dedup(messy)
    rows = suffix_dedup.digest(messy_df.repartition(4)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == want
    assert suffix_dedup.digest(none_of(spark, messy_df)).count() == 0


@pytest.mark.parametrize("one_in", [1, 1 << 30])  # anchors known to be hot before they are dealt, or found so
def test_hot_anchors_match_brute_force(spark, messy, monkeypatch, one_in):
    for name, n in (("TILE", 2), ("ONE_IN", one_in), ("HOT", 3)):
        monkeypatch.setattr(suffix_dedup, name, n)
    passage = dict(messy)[20][300:700]
    docs = [*messy, *((100 + k, f"{k * 7919 % 1000} {'xyz'[: k % 4]}{passage[k * 5 % 60 : 400 - k % 90]} {k * 104729 % 1000}") for k in range(40))]
    rows = suffix_dedup.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == brute.dedup(docs)


def test_repeats_with_repeated_and_null_ids(spark, messy, messy_df):
    twice = messy_df.unionByName(messy_df.filter("doc_id = 10")).unionByName(messy_df.filter("doc_id = 20").withColumn("doc_id", F.lit(None).cast("long")))
    rows = suffix_dedup.digest(twice).collect()
    assert len(rows) == len(messy) + 2
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(r["n_removed"])
    assert by[None] == {0} and len(by[10]) == 1  # null comes first, and rows that repeat wholly are one document
    cleaned = suffix_dedup.without_repeats(messy_df)
    assert cleaned.columns == messy_df.columns and cleaned.filter("doc_id = 11").count() == 0
    assert cleaned.filter("doc_id = 20").first()["text"] == dict(messy)[20]


def test_repeats_leave_columns_of_the_same_names(spark, messy, messy_df):
    names = ("doc", "id", "start", "stop", "spans", "body", "key")
    df = messy_df.select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    cleaned = suffix_dedup.without_repeats(df)
    assert cleaned.columns == df.columns and all(r[n] == f"own {n}" for r in cleaned.collect() for n in names)
    assert suffix_dedup.digest(df).count() == len(messy)


# Decontamination


def test_leaks_match_brute_force(spark, messy, messy_df):
    rng = np.random.default_rng(3)
    by = dict(messy)
    items = [(1, " ".join(by[40].split(" ")[20:60])), (2, "THREE one two"), (3, by[33][-300:]), (4, None), (5, ""), (6, " ".join(rng.choice(by[41].split(" "), 30))), (7, "one two three"), (8, by[20][-260:])]
    edited = by[40].split(" ")
    edited[40] = "edited"
    docs = [*messy, (90, " ".join(edited)), (91, "x " + by[40][5:400].upper())]
    df = messy_df.select("doc_id", "text").unionByName(spark.createDataFrame(docs[-2:], "doc_id long, text string")).withColumn("leaked_items", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks(docs, [(i, t) for i, t in items if t])
    for chars in (decontaminate.BLOCK_CHARS, 200):  # at once, and block by block
        rows = decontaminate.find_leaks(df, bench, block_chars=chars).collect()
        assert {r["doc_id"]: {x["item_id"] for x in r["leaked_items"]} for r in rows} == want
    assert any(want.values()) and decontaminate.find_leaks(df, bench.limit(0)).filter("size(leaked_items) > 0").count() == 0
    assert decontaminate.without_leaks(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("n", [50, 9000])  # few values of a block, and more than masks
def test_lookup_finds_all_within_the_radius(n):
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**64, n, dtype=np.uint64)
    blocks = decontaminate.Blocks(prints, 22)
    for k in range(40):
        for bits in (0, 5, 14, 22):
            flipped = prints[k] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
            want = np.flatnonzero(np.bitwise_count(prints ^ flipped) <= 22)
            assert k in want and blocks.lookup(flipped).tolist() == want.tolist()


def test_weighted_similarity_matches_brute_force():
    """Windows of edited items: exact weighted similarity, and the share of leaks that the Hamming radius finds."""
    rng = np.random.default_rng(13)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary, rng.integers(30, 110)))) for k in range(30)]
    items += [(30 + k, items[k][1] + " and more") for k in range(5)] + [(3, items[7][1])]  # shared shingles, and an item of two texts
    docs = []
    for k in range(90):
        words = items[k % 30][1].split(" ")
        for _ in range(k % 4):
            words[rng.integers(len(words))] = "edited"
        docs.append(" ".join([*rng.choice(vocabulary, 6), *words, *rng.choice(vocabulary, 6)]))
    want = brute.weighted_leaks(docs, items)
    index = decontaminate.Index(items)
    missed = found = 0
    for text, leaks in zip(docs, want):
        got = {i: (start, score) for i, start, score in index.search(text.encode())}
        assert set(got) <= set(leaks)
        for item, (start, score) in leaks.items():
            found, missed = found + (item in got), missed + (item not in got)
            assert item not in got or (np.isclose(got[item][1], score) and got[item][0] == start)
    assert found > 50 and missed <= 0.02 * found


def test_decontamination_takes_long_texts_and_extra_columns(spark, messy):
    by = dict(messy)
    bench = spark.createDataFrame([(1, by[33][5000:5400]), (1, by[41]), (2, by[33][5000:5400])], "item_id long, text string")
    docs = spark.createDataFrame([(33, by[33] * 20, "x"), (33, by[33] * 20, "x"), (None, by[41], "y")], "doc_id long, text string, item_id string")
    rows = decontaminate.find_leaks(docs, bench).collect()
    assert [sorted(x["item_id"] for x in r["leaked_items"]) for r in sorted(rows, key=lambda r: r["doc_id"] or 0)] == [[1], [1, 2], [1, 2]]
    assert {r["item_id"] for r in rows} == {"x", "y"}


# Quality rules


def test_quality_counts_match_brute_force(spark, messy, messy_df):
    rows = quality_rules.judge(messy_df).collect()
    names = (*quality_rules.MEASURES, "base_failed")
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in rows} == {i: brute.quality(t) for i, t in messy}
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert quality_rules.judge(none_of(spark, messy_df)).count() == 0
    kept = quality_rules.keep_good(messy_df)
    assert kept.columns == messy_df.columns and kept.count() == sum(r["kept"] for r in rows)


def test_quality_sketches_merge_and_have_the_error_they_say(spark):
    values = [0.001 * 1.07**k for k in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", quality_rules.bucket(F.col("v")).alias("b"))
    for r in df.collect():
        guess = 2 * quality_rules.GAMMA ** r["b"] / (quality_rules.GAMMA + 1)
        assert abs(guess - r["v"]) <= 1.0001 * quality_rules.ACCURACY * r["v"]


def test_quality_fences_reject_outliers_of_their_source(spark, messy):
    good = [t for i, t in messy if i and i >= 40]
    rows = [(k, good[k % 25] + f" w{k}", "en", "a") for k in range(60)] + [(99, " ".join(w + "***" for w in good[0].split()), "en", "a"), (98, good[1], None, None)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept.pop(99) and all(kept.values())


def test_quality_fences_follow_the_spread_of_a_source(spark, messy):
    """The same outlier is kept in a source whose documents vary and rejected in one whose don't, for every measure."""
    rng = np.random.default_rng(6)
    word = lambda size: "".join(rng.choice(list("abcdefgh"), size))

    def text(n=200, length=5, symbols=0, equal_lines=0, repeats=0):
        words = [word(length) for _ in range(n)]
        words[:symbols] = [w + "$" for w in words[:symbols]]
        words[20 : 20 + 3 * repeats] = words[:3] * repeats
        lines = [" ".join(words[i : i + 10]) for i in range(0, n, 10)]
        return "\n".join(lines + [lines[-1][:40]] * 0 + ["an equal line"] * (equal_lines + 1))

    def varied(k):
        n = int(60 * 1.12 ** (k % 30))
        shares = [(37 * k + shift) % 100 / 110 for shift in (0, 31, 63)]
        lines = n // 10
        return text(n, 3 + k % 9, int(n * shares[0]), int(lines * shares[1] / (1 - shares[1])), int((n - 20) * shares[2] / 2) // 3)

    odd = {"n_words": dict(n=2500), "word_length": dict(length=12), "symbol_share": dict(symbols=60), "dup_line_share": dict(equal_lines=12), "repeat_share": dict(repeats=14)}
    found = {}
    for source, make in (("even", lambda k: text()), ("varied", varied)):
        # three of each kind, so that each share's tail is seen at the 99th percentile
        rows = [(k, make(k), "en", source) for k in range(100)] + [(100 + i, text(**kind), "en", source) for i, kind in enumerate(3 * list(odd.values()))]
        kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
        found[source] = [kept[100 + i] for i in range(3 * len(odd))]
        assert sum(kept[k] for k in range(100)) >= (100 if source == "even" else 60)  # equal lines are repeated words too
    assert found == {"even": [False] * 3 * len(odd), "varied": [True] * 3 * len(odd)}


def test_quality_shares_without_a_tail_take_the_next_level_up(spark):
    """All but a few documents of a language have no symbol: a source of clean ones alone has no tail of its own."""
    rng = np.random.default_rng(8)
    text = lambda symbols: " ".join("".join(rng.choice(list("abcdefgh"), 5)) + "$" * (i < symbols) for i in range(200))
    rows = [(k, text(0), "en", "clean") for k in range(50)] + [(100 + k, text(80 if k < 6 else 0), "en", "mixed") for k in range(50)]
    rows += [(200 + k, text(0), "de", "clean") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counted = quality_rules.with_repeats(quality_rules.with_counts(df))
    limits = {(r["lang"], r["source"]): r["__symbol_share_high"] for r in quality_rules.fences(quality_rules.sketches(counted)).collect()}
    assert set(limits) == {("en", "mixed"), ("en", "clean"), ("de", "clean")} and all(0.25 < x < 0.42 for x in limits.values())
    none = quality_rules.fences(quality_rules.sketches(counted.filter("source = 'clean'"))).collect()
    assert all(r["__symbol_share_high"] is None and r["__n_words_high"] is not None for r in none)
    more = df.unionByName(spark.createDataFrame([(300, text(90), "en", "clean")], df.schema))
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(more).collect()}
    assert not kept[300] and all(kept[k] for k in range(50)) and all(kept[106 + k] for k in range(44))


def test_quality_takes_clashing_names_null_groups_and_long_lines(spark, messy):
    good = [t for i, t in messy if i and i >= 40]
    rows = [(k, good[k % 25], None, None, k, "mine", True) for k in range(50)] + [(60, None, None, None, 1, "mine", None), (61, "word " * 50_000, "en", None, 2, "mine", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines long, word_length_low string, kept boolean").withColumn("nothing", F.lit(None))
    out = quality_rules.judge(df)
    assert set(out.columns) == {*df.columns, *quality_rules.MEASURES, "base_failed"}
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == 52 and got[3]["n_lines"] == 3 and got[3]["word_length_low"] == "mine" and got[3]["kept"] and not got[60]["kept"] and got[61]["base_failed"]
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and {r["n_lines"] for r in kept.collect()} == {r["n_lines"] for r in out.filter("kept").collect()}


def test_quality_rules_are_native(spark, messy_df):
    plan = quality_rules.keep_good(messy_df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# Chat formatting


def test_roles_are_recovered(spark):
    conversations = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    found = chat_format.format_chats(conversations).withColumnRenamed("role", "found")
    rows = conversations.join(found, ["conv_id", "turn"]).filter(F.pmod(F.xxhash64("conv_id"), F.lit(4)) == 0).collect()
    assert rows and sum(r["role"] == r["found"] for r in rows) >= 0.95 * len(rows)
    assert all(r["rendered"].startswith(f"<|{r['found']}|>\n") for r in rows)


def test_paths_match_enumeration():
    """Viterbi's path has the best score of all paths, and stretches chained by their matrices give the same."""
    from itertools import product

    rng = np.random.default_rng(12)
    n, emit = chat_format.N, sum(chat_format.SIZES)
    for length in (1, 2, 4):
        start, step = np.log(rng.dirichlet(np.ones(n))), np.log(rng.dirichlet(np.ones(n), n))
        decoder = chat_format.Decoder(start, step, np.log(rng.random((emit, n))))
        scores = decoder.scores([tuple(int(rng.integers(s)) for s in chat_format.SIZES) for _ in range(length)])
        score = lambda p: start[p[0]] + scores[0, p[0]] + sum(step[a, b] + scores[i, b] for i, (a, b) in enumerate(zip(p, p[1:]), 1))
        best = max(product(range(n), repeat=length), key=score)
        assert decoder.path(scores, None, None).tolist() == list(best)
        assert np.isclose(decoder.matrix(scores)[n].max(), score(best))


def test_a_conversation_over_many_tasks_is_one(spark, data):
    raw = chat_format.transcripts(spark.read.parquet(f"{data}/conversations.parquet"))
    model = chat_format.learn(raw, "conv_id", "turn", "text", "role")
    one = spark.createDataFrame([(1, k, r["text"]) for k, r in enumerate(raw.orderBy("conv_id", "turn").limit(60).collect())], "conv_id long, turn long, text string")
    a, b = (sorted(map(tuple, chat_format.parse(one, model, partitions=n).collect())) for n in (1, 7))
    assert a == b and len(a) == 60


def test_chat_takes_odd_rows(spark, data):
    raw = chat_format.transcripts(spark.read.parquet(f"{data}/conversations.parquet"))
    model = chat_format.learn(raw, "conv_id", "turn", "text", "role")
    odd = spark.createDataFrame([(None, None, None, "x"), (None, None, None, "x"), (1, 0, "", "x"), (1, 1, "User: hi\n\nAssistant: ho\nAI", "x"), (2, 0, "**System:**\nrules", "x")], "conv_id long, turn long, text string, rendered string")
    rows = {(r["conv_id"], r["turn"]): r for r in chat_format.parse(odd, model).collect()}
    assert len(rows) == 4 and rows[1, 1]["n_turns"] == 2
    assert rows[1, 1]["rendered"] == "<|user|>\nhi\n\n<|assistant|>\nho\nAI" and rows[2, 0]["rendered"] == "<|system|>\nrules"
    assert chat_format.parse(odd.limit(0), model).count() == 0


# Similarity join


def test_components_match_brute_force(spark, messy, messy_df):
    want = brute.components([(i, t) for i, t in messy])
    rows = parity_join.join_similar(messy_df.repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {i: len(set(brute.shingles(t))) for i, t in messy}
    assert parity_join.join_similar(none_of(spark, messy_df)).count() == 0


def test_a_large_group_of_near_copies_around_a_common_passage(spark, messy, monkeypatch):
    monkeypatch.setattr(parity_join, "TILE", 16)
    rng = np.random.default_rng(2)
    base, passage = dict(messy)[10].split(" "), dict(messy)[41]
    docs = []
    for k in range(120):
        words = list(base)
        for at in rng.choice(len(words), 1 + k % 5, replace=False):
            words[at] = f"w{rng.integers(999)}"
        docs.append((k, " ".join(words)))
    docs += [(200 + k, " ".join(f"u{rng.integers(10**6)}" for _ in range(130)) + " " + passage) for k in range(80)]
    found = parity_join.join_similar(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == brute.components(docs)


def test_keys_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    for n in (1, 4, 9, 40, 64, 66, 90, 129, 300, 1500):
        for _ in range(20):
            s = rng.integers(0, 2**63, n).astype(np.uint64)
            drop = int(n * 0.25)
            a, b = np.sort(s), np.sort(s[drop:])
            assert not parity_join.linked(a, b) or set(parity_join.block_keys(a)[0].tolist()) & set(parity_join.block_keys(b)[0].tolist())


def test_sketches_never_reject_a_link():
    rng = np.random.default_rng(8)
    rejected = 0
    for n in (1, 5, 40, 64, 65, 129, 130, 131, 400, 2000):
        for share in (0.5, 0.7, 0.74, 0.75, 0.76, 0.9):
            union = rng.integers(0, 2**63, n).astype(np.uint64)
            common = round(share * len(union))
            a, b = np.sort(union[: (len(union) + common) // 2]), np.sort(union[(len(union) - common) // 2 :])
            sa, sb = parity_join.sketch(a), parity_join.sketch(b)
            size = min(len(sa), len(sb))
            apart = np.bitwise_count(parity_join.folded(sa, size) ^ parity_join.folded(sb, size)).sum()
            assert apart <= len(np.setxor1d(a, b))
            passes = parity_join.may_link(len(a), sa, len(b), sb)
            assert passes or not parity_join.linked(a, b)
            rejected += not passes
            assert share > 0.55 or n < 64 or not passes
    assert rejected


def test_texts_of_a_repeated_id_all_link(spark, messy):
    by = dict(messy)
    rows = [(1, by[40]), (1, by[10]), (2, by[12]), (3, by[40] + " more"), (4, by[41]), (4, by[42]), (5, by[42]), (5, by[41]), (6, by[43])]
    found = parity_join.join_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)} and len(found) == len(rows)


def test_linked_pairs_are_all_found(spark):
    """Recall against brute force: pairs at the threshold, in every size band."""
    rng = np.random.default_rng(11)
    docs = []
    for k, n in enumerate((20, 64, 70, 120, 140, 250, 300, 500, 700, 1200) * 4):
        words = [f"p{k}w{i}" for i in range(n + 4)]
        docs.append((2 * k, " ".join(words)))
        cut = int(n * 0.25) - 1  # a suffix of three quarters of the shingles
        docs.append((2 * k + 1, " ".join(words[cut:])))
    docs = [docs[i] for i in rng.permutation(len(docs))]
    found = parity_join.join_similar(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == brute.components(docs)


def test_one_of_each_group_stays(spark, messy_df):
    more = messy_df.unionByName(messy_df.filter("doc_id IN (10, 40)")).unionByName(messy_df.filter("doc_id = 12").withColumn("doc_id", F.lit(None).cast("long")))
    kept = parity_join.keep_one(more)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == messy_df.columns and ids.count(10) == 1 and ids.count(40) == 1 and None in ids and 11 not in ids and 5 not in ids


# Token counts


def test_token_counts_match_the_library(spark, messy, messy_df, library):
    rows = token_count.count_tokens(messy_df, queries.tokenizer("byte_bpe_50k.json")).collect()
    want = {i: len(ids_of(library, t)) for i, t in messy}
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want
    assert all(r["n_bytes"] == len((dict(messy)[r["doc_id"]] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 512) for r in rows)
    assert token_count.count_tokens(none_of(spark, messy_df), queries.tokenizer("byte_bpe_50k.json")).count() == 0


def test_token_counts_take_repeated_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 9), (1, "a b", 9)], "doc_id long, text string, n_tokens long")
    rows = token_count.count_tokens(df, queries.tokenizer("byte_bpe_50k.json")).collect()
    assert [(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows] == [(3, 2, False)] * 2


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": {"type": "Whitespace"}}])
def test_vocabularies_that_change_texts_are_rejected(change):
    import json

    model = json.load(open(queries.tokenizer("byte_bpe_50k.json"))) | change
    with pytest.raises(ValueError):
        token_count.MergeCounter(json.dumps(model).encode())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_merges_match_the_library(text):
    library = tokenizers.Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    counter = _counter()
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def _counter(cache=[]):  # noqa: B006
    if not cache:
        cache.append(token_count.MergeCounter(open(queries.tokenizer("byte_bpe_50k.json"), "rb").read()))
    return cache[0]


def test_encoder_matches_the_library(messy, library):
    table = open(queries.tokenizer("byte_bpe_50k.tiktoken"), "rb").read()
    encode = packing.Encoder(table, {"<|endoftext|>": 50256})
    for _, t in messy:
        assert encode(t or "").tolist() == ids_of(library, t)


# Any operator


INNER = "doc spans name id words hashes sorted places lines n_lines lang source judged best counted gone again cut n_words_low f0 own_kept".split()


@pytest.mark.parametrize("operator", ["filter_urls", "count_tokens", "without_repeats", "digest", "without_leaks", "find_leaks", "judge", "keep_good", "keep_one", "transform"])
def test_columns_with_inner_names_stay_the_rows_own(spark, messy, operator):
    """Tables with a column of every inner name, the names of results among them."""
    columns = [*(f"__{k}" for k in INNER), "leaked_items", "doc", "spans", "key", "part"]
    rows = [(i, t, "en", "a", *range(len(columns))) for i, t in messy[3:16]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` long" for c in columns))
    bench = spark.createDataFrame([(1, messy[8][1]), (None, messy[9][1]), (None, messy[9][1] + " and more")], "item_id long, text string")
    call = {
        "filter_urls": lambda: url_filter.filter_urls(df, url="text"),
        "count_tokens": lambda: token_count.count_tokens(df, queries.tokenizer("byte_bpe_50k.json")),
        "without_repeats": lambda: suffix_dedup.without_repeats(df),
        "digest": lambda: suffix_dedup.digest(df),
        "without_leaks": lambda: decontaminate.without_leaks(df, bench),
        "find_leaks": lambda: decontaminate.find_leaks(df, bench, block_chars=400),
        "judge": lambda: quality_rules.judge(df),
        "keep_good": lambda: quality_rules.keep_good(df),
        "keep_one": lambda: parity_join.keep_one(df),
        "transform": lambda: fill_in_middle.transform(df),
    }[operator]
    out = call()
    have = out.collect()
    assert have or operator == "without_leaks"
    if operator == "digest":
        assert len(have) == len(rows)
        return
    lost = {"find_leaks": {"leaked_items"}}.get(operator, set())
    for c in set(columns) - lost:
        assert {r[c] for r in have} == ({columns.index(c)} if have else set()), c
    if operator == "find_leaks":
        leaks = {r["doc_id"]: [x["item_id"] for x in r["leaked_items"]] for r in have}
        assert leaks[10] and None in leaks[12] and all(not leaks[i] for i in (4, 5, 6))


def test_join_over_all_blocks_matches_brute_force(spark):
    """All blocks lose no pair, whatever the sizes."""
    rng = np.random.default_rng(31)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    docs = []
    for n in (70, 90, 128, 131, 200, 257, 400, 700):
        for _ in range(6):
            text = words(n)
            docs.append(text)
            for edits in (1, n // 100 + 1, n // 60 + 1, n // 40):
                other = list(text)
                for at in rng.integers(0, n, edits):
                    other[at] = "edited"
                docs.append(other)
    rows = [(k, " ".join(d)) for k, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.components(rows)
    have = {r["doc_id"]: r["component_id"] for r in parity_join.join_similar(df, blocks=None).collect()}
    assert have == want and len(set(want.values())) < len(rows)
    for _, text in rows[::7]:
        s = parity_join.shingle_set(text)
        assert len(parity_join.block_keys(s, None)[0]) >= len(parity_join.block_keys(s)[0])


def test_runs_delete_their_own_tables_only(spark):
    from tessera.llm import common

    other = common.written(spark.range(3))
    with common.own_tables() as mine:
        first, second = common.written(spark.range(5)), common.written(spark.range(7))
        common.discard_but(second, mine)
        assert second.count() == 7 and other.count() == 3 and id(first) not in common._paths
    with pytest.raises(RuntimeError):
        with common.own_tables() as mine:
            third = common.written(spark.range(5))
            raise RuntimeError
    assert id(third) not in common._paths and second.count() == 7
    common.discard(other, second)
