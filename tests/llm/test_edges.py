"""Bounds, odd rows and figures of the training-data operators against plain versions that share no code with them."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same
from tokenloom.llm import chat, decontam, lines, mixing, neardup, pii, quality, registry, secrets, tokens
from tokenloom.llm.common import table


# Chat formatting.


def test_windows_take_all_that_fits(spark):
    r = random.Random(1)
    rows = [(c, i, "system" if i == 0 and c % 2 else ("user", "assistant")[i % 2], "x" * r.choice([0, 3, 40, 400, 4000])) for c in range(6) for i in range(r.choice([1, 7, 150]))]
    rows += [(None, None, None, None), (None, None, None, None), (0, 0, "user", "x")]
    rows += [(99, i, "user", "y" * 30) for i in range(3000)]  # a hot conversation
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("window", F.lit("z")).withColumn("cap", F.lit(1))
    got = {}
    for x in chat.windows(df, budget=512, history=96).where("target").collect():
        got.setdefault(x["conv_id"], {})[x["place"]] = x["window"]
    own = {}
    for c, t, role, text in rows:
        own.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    for c, turns in own.items():
        turns.sort()
        size = [math.ceil(len(t) / 4) + 4 for _, _, t in turns]
        sys = turns[0][1] == "system"
        cap, used, window = max(512 - 96 - (size[0] if sys else 0), 128), 0, 0
        for k, n in enumerate(size):
            if sys and k == 0:
                n = 0
            if used and used + n > cap:
                window, used = window + 1, 0
            used += n
            assert got[c][k + 1] == window, (c, k)


# Separator scan.


def test_token_files_keep_all_ids(spark):
    ids = [0, 1, -3, 5, 2**62 + 5, 2**63 - 1, -(2**63), 49_999, 50_000, None]
    df = spark.createDataFrame([(i, "some words here") for i in ids], "doc_id bigint, text string")
    got = [r["doc_id"] for r in tokens.token_counts(df).collect()]
    assert sorted(got, key=str) == sorted(ids, key=str)
    with pytest.raises(TypeError):
        tokens.token_counts(df.withColumn("doc_id", F.lit("a")))


# Line frequency.


def test_rows_of_one_id_are_one_document(spark):
    body = " ".join(f"w{k}" for k in range(30))
    rows = [(1, "a shared line of words\n" + body, "h")] * 10 + [(2, "a shared line of words\n" + body + " x", "h"), (None, "a shared line of words\n" + body, "h")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = lines.line_quality(df, min_docs=3).collect()
    assert len(got) == 12 and {r["removed_words"] for r in got} == {0}
    assert {r["removed_words"] for r in lines.line_quality(df, min_docs=1).collect()} == {5, 35}


def test_a_hot_host_has_no_higher_bar(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, ("All rights reserved by the host\n" if i % 80 == 0 else "") + own(i), "hot") for i in range(20_000)]
    got = lines.common_lines(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert [r["docs"] for r in got] == [250]


def test_lines_equal_sql_with_repeated_ids(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.randint(0, 40), "\n".join(r.choice(["one line of five words", "another line", "Line three", f"own {r.random()}"]) for _ in range(r.randint(0, 9))) * r.randint(0, 3), r.choice(["a", "b"])) for _ in range(12)]
    rows = list({x[0]: x for x in rows}.values()) + [(100 + i, "one line of five words\n" * 4 + " ".join(f"{i}w{k}" for k in range(25)), "a") for i in range(12)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    same(registry.queries()["op4_line_frequency"](spark, str(tmp_path)), registry.oracle_sql()["op4_line_frequency"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'"), connect(str(tmp_path / "none")))


# Secrets.


def plain_battery(s, letters):
    x = [letters.index(c) for c in s]
    n, k = len(x), len(letters)
    tail = lambda z: max(math.erfc(z / math.sqrt(2)) / 2, 1e-16)
    chi = sum((c - n / k) ** 2 / (n / k) for c in Counter(x).values()) + (k - len(set(x))) * n / k
    p1 = tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    high = [2 * v >= k for v in x]
    n1, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 2 * n1 * (n - n1) / n + 1
    sd = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    p2 = min(1, 2 * tail(abs(runs - mean) / sd))
    d = [v - sum(x) / n for v in x]
    rho = sum(a * b for a, b in zip(d, d[1:])) / max(sum(v * v for v in d), 1e-9)
    p3 = min(1, 2 * tail(abs(rho + 1 / n) * math.sqrt(n)))
    h = -math.log(p1) - math.log(p2) - math.log(p3)
    return p1, p2, p3, math.exp(-h) * (1 + h + h * h / 2)


def test_battery_equals_plain_tests(spark):
    r = random.Random(7)
    letters = {name: a for name, _, a in secrets.ENCODINGS}
    rows = [("hex", "".join(r.choice("0123456789abcdef") for _ in range(n))) for n in (24, 40, 64, 128)] + [("hex", "0123456789abcdef" * 2), ("hex", "deadbeef0" * 4)]
    rows += [("base64", "".join(r.choice(letters["base64"]) for _ in range(n)) + "+/aZ9") for n in (30, 43, 86)] + [("base64", "aB3" * 15 + "+")]
    for x in spark.createDataFrame(rows, "e string, s string").select("e", "s", secrets.battery(F.col("s")).alias("t")).collect():
        p1, p2, p3, p = plain_battery(x["s"], letters[x["e"]])
        t = x["t"]
        assert t["encoding"] == x["e"] and t["n"] == len(x["s"])
        assert (t["uniformity"], t["runs"], t["correlation"]) == pytest.approx((p1, p2, p3), abs=1e-6)
        assert t["p"] == pytest.approx(max(p, 1e-16), rel=1e-3, abs=1e-6)


def test_false_secrets_stay_below_the_level():
    r = np.random.default_rng(3)
    for keys, others in ((1000, 300), (300, 3000), (0, 500), (500, 0)):
        p = np.concatenate([r.random(keys), 10 ** -r.exponential(1.2, others) * 0.15])
        b = np.floor(-np.log10(p) * 20).astype(int)
        at = secrets.cut(sorted(Counter(b.tolist()).items()), 0.05, 0.01)
        shown = b < at
        false = (shown[keys:].sum() / max(shown.sum(), 1)) if keys else 0
        assert false < 0.1, (keys, others, false)
        assert not keys or shown[:keys].mean() > 0.75


# Personal data.


def test_reliabilities_are_those_the_votes_were_drawn_with():
    """Votes drawn from known shares: posteriors match the truth that drew them, and no labeler is believed beyond its share."""
    r = random.Random(11)
    yes, no, truth = (0.9, 0.8, 0.85, 0.95, 0.7), (0.2, 0.3, 0.1, 0.05, 0.4), {}
    for _ in range(40_000):
        z = r.random() < 0.4
        v = "".join("0" if r.random() < 0.2 else "+" if r.random() < (yes if z else no)[k] else "-" for k in range(5))
        n = truth.setdefault(v, [0, 0])
        n[z] += 1
    post = pii.expectation_maximisation([("phone", v, a + b) for v, (a, b) in truth.items()], rounds=300)

    def exact(v):
        odds = math.log(0.4 / 0.6) + sum(math.log(yes[k] / no[k]) if c == "+" else math.log((1 - yes[k]) / (1 - no[k])) if c == "-" else 0 for k, c in enumerate(v))
        return 1 / (1 + math.exp(-odds))

    n = sum(a + b for a, b in truth.values())
    assert sum((a + b) * abs(post["phone", v] - exact(v)) for v, (a, b) in truth.items()) / n < 0.02


def test_gazetteers_propose_spans():
    t = "write to jane.doe at mail dot example dot org, call 0049 30 1234 5678, card 3056 930902 5904, host fe80::1ff:fe23:4567:890a; the cat at home dot dot"
    got = [(k, t[s:e]) for k, s, e in pii.gazetteer_spans(t)]
    assert got == [("email", "jane.doe at mail dot example dot org"), ("phone", "0049 30 1234 5678"), ("card", "3056 930902 5904"), ("ip", "fe80::1ff:fe23:4567:890a")]
    assert pii.apart([("a", 0, 5), ("b", 3, 9), ("c", 12, 15), ("d", 5, 6)], [("x", 13, 20), ("y", 5, 6)]) == [("a", 0, 5)]


def test_classifier_separates_by_what_stands_around(spark):
    rows = [(i, f"phone 415-555-{1000 + i} please") for i in range(300)] + [(1000 + i, f"serial 415-555-{1000 + i} part") for i in range(300)] + [(2000, "my 415-555-9999 is new")]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got[i] == ["phone"] for i in range(300)) > 290 and not any(got[1000 + i] for i in range(300))


# Labels.


def test_labels_of_absent_documents_leave_the_bound_alone(spark):
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} word{i}") for i in range(50)], "doc_id bigint, text string")
    labels = spark.range(100_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    assert quality.labelled(docs, labels, F.col("quality"), 1000, "doc_id", "text").count() == 50
    assert quality.labelled(docs, labels, F.col("quality"), 20, "doc_id", "text").count() == 20


# Near-duplicates.


def test_crowds_keep_their_only_links(spark):
    """Pairs whose one link is each other, in a crowd that shares half its words: none is lost when the crowd is branched on and cut into blocks."""
    r = random.Random(8)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for g in range(150):
        w = common + [f"u{g}x{k}" for k in range(40)]
        v = list(w)
        v[70] = "changed"  # 91 of 101 shingles stay
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(v))]
    r.shuffle(rows)
    for limit in (1000, 20):
        got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), node_limit=limit).collect()}
        assert all(got[2 * g] == got[2 * g + 1] == 2 * g for g in range(150))


# Decontamination.


def test_small_shards_equal_sql(spark, sf):
    found = decontam.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"), shard_words=50)
    out = found.select("doc_id", "n_words", decontam.n_hit().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
    same(out, registry.oracle_sql()["op10_decontam_suffix_array"], connect(sf))


def test_shared_windows_are_searched_once():
    items = [(k, f"a template that all of these items share word for word q{k}") for k in range(10_000)]
    text = ("a template that all of these items share word for word and more " * 1000).encode()
    ((_, spans, names, longest, at, item),) = decontam.find(decontam.split([text], inside=decontam.ALNUM), decontam.TestSet(items, 10))
    assert len(names) == 10_000 and len(spans) == 1000 and (longest, at, item) == (11, 0, "0")


def test_items_without_an_id_are_apart(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five six")], "doc_id bigint, text string")
    bench = spark.createDataFrame([("None", "one two three"), (None, "four five six"), (None, "one two three")], "item_id string, text string")
    got = {r["doc_id"]: r["items"] for r in decontam.decontaminate(docs, bench).collect()}
    assert got == {1: ["None", None], 2: [None]}


def test_longest_matches_of_items(spark):
    r = random.Random(9)
    word = lambda: r.choice("abcde")
    docs = [(i, " ".join(word() for _ in range(r.randint(0, 40)))) for i in range(12)] + [(None, "a b c")]
    items = [(f"i{k}", " ".join(word() for _ in range(r.randint(0, 12)))) for k in range(5)] + [("none", "zz yy")]
    want = {}
    for name, t in items:
        v, best = t.split(), None
        for i, d in docs:
            w = d.split()
            for p in range(len(w)):
                for s in range(len(v)):
                    n = 0
                    while p + n < len(w) and s + n < len(v) and w[p + n] == v[s + n]:
                        n += 1
                    if n and (best is None or (-n, i is None, i or 0) < best[0]):
                        best = ((-n, i is None, i or 0), n, i)
        if best:
            want[name] = best[1:]
    for words in (1_000_000, 9):
        got = {x["item_id"]: (x["longest"], x["id"]) for x in decontam.longest_matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string"), shard_words=words).collect()}
        assert got == want


# Pipeline stages on odd rows.


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    long = "one two three four five six seven eight nine ten " * 3000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "password = hunter2hunter2 and more words of a text here"), (4, "password = hunter2hunter2 and more words of a text here"), (None, "no id here at all"), (5, long), (6, long), (7, "é ü")]
    docs = spark.createDataFrame([(i, t, "en", None, len(t) if t is not None else None, 1, "z") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, rate int, `__t__` string")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("a", "nothing of this is anywhere"), (None, None)], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_on_odd_rows(spark, odd):
    import corpus_pipeline as p

    docs = table(spark, odd, "documents")
    for name, stage in p.STAGES:
        out = stage(spark, docs, odd)
        got = out.collect()
        assert len(got) <= 9 and (out.columns == docs.columns if name != "target_mixing" else set(docs.columns) <= set(out.columns)), name
        if name == "secret_redaction":
            assert sum("[SECRET]" in (r["text"] or "") for r in got) == 2 and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["__t__"] == "z" for r in got)
        if name == "near_duplicates":
            assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 7]
        if name == "decontamination":
            assert len(got) == 9
        if name == "target_mixing":
            assert len(got) == 9 and all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1 for r in got)
        assert stage(spark, docs.limit(0), odd).count() == 0, name
    assert p.run(spark, odd).count() <= 9


def test_without_labels_no_row_goes(spark, odd, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert quality.keep_good(spark, table(spark, odd, "documents"), str(tmp_path)).count() == 9


def test_copies_come_to_the_rates(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 7 / 3).alias("rate")).withColumn("n", mixing.copies(F.col("rate"), F.col("id")))
    got = df.agg(F.sum("n").alias("n"), F.sum("rate").alias("r"), F.max(F.abs(F.col("n") - F.col("rate"))).alias("d")).first()
    assert got["n"] == pytest.approx(got["r"], rel=0.02) and got["d"] < 1


def test_folds_are_those_of_the_contract(spark):
    got = quality.classify(spark.createDataFrame([(i, "x") for i in range(50)], "doc_id bigint, text string"), spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


@pytest.mark.parametrize("wanted", [1, 7, 100])
def test_lowest_rows_by_leading_bits(spark, wanted):
    rows = spark.range(3000).select(F.xxhash64("id").alias("h")).union(spark.createDataFrame([(5,)] * 20 + [(-(2**63),)] * 3 + [(2**63 - 1,)], "h bigint"))
    h = sorted(r["h"] for r in rows.collect())
    got = sorted(r["h"] for r in pii._lowest(rows, wanted, len(h)).collect())
    assert got[:wanted] == h[:wanted] and got == h[: len(got)] and len(got) <= 2 * wanted + 20
    assert pii._lowest(rows, 5000, len(h)).count() == len(h)
