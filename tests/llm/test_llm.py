"""Each operator against brute force or SQL, and on awkward rows: nulls, empty and very long texts, ties, repeats, empty tables, extra columns."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same
from tokenloom.llm import chat, decontam, lines, lm, mixing, neardup, pii, quality, registry, secrets, tokens, words
from tokenloom.llm.common import table

LONG = "one two three four five six seven eight nine ten " * 4000
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "The quick brown fox jumps over the lazy dog again and again."), (5, "The quick brown fox jumps over the lazy dog again and again."),
    (6, "The quick brown fox jumps over the lazy dog again and again."), (None, "no id é here"), (7, LONG), (8, "a\x1cb \x85 ü ÀB\x0bc"), (9, None), (10, "x" * 50000),
]


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame([(i, t, "en", None, 9, 7, "z") for i, t in AWKWARD], "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, kept string")
    return df.withColumn("spans", F.lit(1)).withColumn("score", F.lit("s")).withColumn("rate", F.lit(0)).withColumn("label", F.lit(1))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (7, 0, 1), (4, None, 0), (None, 1, 1), (5, 1, 0), (99, 1, 0)], "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("name", ["op1_chat_windows", "op4_line_frequency", "op9_chosen_path_join", "op10_decontam_suffix_array"])
def test_equals_sql(spark, sf, name):
    same(registry.queries()[name](spark, sf), registry.oracle_sql()[name], connect(sf))


def word_list(t, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_words_equal_the_pattern():
    texts = [t for _, t in AWKWARD]
    b = words.split([None if t is None else t.encode() for t in texts])
    assert [[w.decode() for w in b.words(i)] for i in range(b.n_docs)] == [word_list(t) for t in texts]
    a = words.split([None if t is None else t.encode() for t in texts], inside=words.ALNUM)
    assert [[w.decode() for w in a.words(i)] for i in range(a.n_docs)] == [word_list(t, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+") for t in texts]
    seen = {}
    for w, h in zip((w for i in range(b.n_docs) for w in b.words(i)), b.hashes().tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


# Chat formatting.


def test_chat_round_trip(spark):
    r = random.Random(2)
    bits = [*chat.CONTROLS, "\\", "<", "[", "\n", "x", "é", "s>", "INST]", " "]
    text = lambda n=12: "".join(r.choice(bits) for _ in range(r.randint(0, n)))
    rows = [(c, i, r.choice(["user", "assistant", "system", text(3), None]), r.choice([text(), text(200), None]), "x") for c in range(25) for i in range(r.randint(1, 20))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, window string")
    out = chat.format_chats(df, budget=200, history=40)
    got, loss = {}, {}
    for row in out.select("conv_id", "window", "formatted", "loss", chat.read_back(F.col("formatted"), F.col("repeated")).alias("t")).orderBy("conv_id", "window").collect():
        got.setdefault(row["conv_id"], []).extend((x["role"], x["text"]) for x in row["t"])
        loss.setdefault(row["conv_id"], []).extend(row["formatted"][s["start"] : s["end"]] for s in row["loss"])
        assert not any(x in row["formatted"] for x in chat.CONTROLS if x not in (chat.START, chat.END))
    want = {}
    for c, _, role, t, _ in sorted(rows, key=lambda x: x[:2]):
        want.setdefault(c, []).append((role or "", t or ""))
    assert got == want
    assert {c: len(x) for c, x in loss.items()} == {c: sum(role == "assistant" for role, _ in x) for c, x in want.items()}


def test_chat_windows_keep_the_budget(spark):
    df = spark.createDataFrame([(c, i, "system" if i == 0 else ("user", "assistant")[i % 2], "abcd" * (i * 7 % 30)) for c in (None, 1) for i in range(60)], "conv_id bigint, turn bigint, role string, text string")
    w = chat.windows(df, budget=200, history=40).groupBy("conv_id", "window").agg(F.sum("n_tokens").alias("n"), F.min("place").alias("first"))
    assert w.where("n > 200").count() == 0 and w.where("first <> 1").count() == 0 and w.where("window = 1").count() == 2


def test_chat_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


# Separator scan.


def test_scan_stitches_blocks(spark, tmp_path):
    r = np.random.default_rng(1)
    for k in range(3):
        ids = np.where(r.random(500) < 0.05, 7, r.integers(8, 90, 500)).astype("<u2")
        (tmp_path / f"f{k}").write_bytes(ids.tobytes() + b"\x01" * k)
    (tmp_path / "empty").write_bytes(b"")
    want = []
    for k in range(3):
        raw = (tmp_path / f"f{k}").read_bytes()
        ids = np.frombuffer(raw[: len(raw) // 2 * 2], "<u2").tolist()
        start = 0
        for n, at in enumerate([*[i for i, x in enumerate(ids) if x == 7], None]):
            own = ids[start:at]
            if at is not None or own:
                want.append((f"f{k}", n, start, len(own), at is not None, own[:3]))
            start = (at or 0) + 1
    for block in (3, 7, 64, 10_000):
        got = tokens.scan(spark, str(tmp_path), 7, 2, block, head=3).collect()
        assert sorted((x["path"].rpartition("/")[2], x["ordinal"], x["start"], x["n_tokens"], x["closed"], x["head"]) for x in got) == sorted(want)


def test_token_counts(spark, awkward):
    enc = tokens._encoder(open(tokens.VOCABULARY, "rb").read())
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in tokens.token_counts(awkward).collect())
    assert got == sorted((i or -1, len(enc.encode_ordinary(t or ""))) for i, t in AWKWARD)
    assert tokens.token_counts(awkward.limit(0)).count() == 0


# Language model.


def test_lm_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    want = lm.brute_force(rows)
    for chunk, shard in ((8_000_000, 1_000_000), (20_000, 5_000)):
        for r in lm.score(table(spark, sf, "documents"), chunk_bytes=chunk, shard_tokens=shard).collect():
            w = want[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
            assert r["base_score"] == pytest.approx(w[4]) and r["score"] == pytest.approx(w[5])
    held = [w for w in want.values() if w[0]]
    assert sum(w[5] for w in held) > sum(w[4] for w in held)


def test_lm_awkward(spark, awkward):
    got = lm.score(awkward).collect()
    assert len(got) == len(AWKWARD) and all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert [r["n_tokens"] for r in got if r["doc_id"] == 1] == [1]
    assert lm.score(awkward.limit(0)).count() == 0
    only_held = awkward.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1)
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0 for r in lm.score(only_held).collect())


# Line frequency.


def test_lines_awkward(spark, awkward):
    got = {(r["doc_id"], r["n_words"]): r for r in lines.line_quality(awkward).collect()}
    assert got[1, 0]["base_failed"] and not got[2, 0]["kept"] and got[7, 40000]["n_repeat_words"] == 40000
    assert lines.line_quality(awkward.limit(0)).count() == 0


def test_lines_above_the_limits_go(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, "Shared  LINE of the host here\n" * 2 + own(i), "a") for i in range(30)] + [(100 + i, "\n".join(f"common line number {k} of many" for k in range(8)), "a") for i in range(12)] + [(200, "\n".join(f"common line number {k} of many" for k in range(8)), "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for block in (4_000_000, 2):
        got = {r["doc_id"]: r for r in lines.line_quality(df, block_lines=block).collect()}
        assert all(got[i]["kept"] and got[i]["removed_words"] == 12 and got[i]["n_dup_lines"] == 1 for i in range(30))
        assert not any(got[100 + i]["kept"] for i in range(12)) and got[200]["kept"]


# Personal data.


def test_pii_equals_brute_force(spark, sf):
    r = random.Random(1)
    odd = [(10_000 + k, "".join(r.choice("a1.@+- ()9:4_%x\n") for _ in range(r.randint(0, 40)))) for k in range(1500)]
    docs = table(spark, sf, "documents").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id bigint, text string"))
    texts = {x["doc_id"]: x["text"] for x in docs.collect()}
    for x in pii.find_pii(docs).collect():
        base = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in x["spans"] if s["strict"])
        counts, digest = pii.brute_force(texts[x["doc_id"]])
        assert hashlib.sha256(base.encode()).hexdigest() == digest
        assert all(sum(s["strict"] and s["kind"] == k for s in x["spans"]) == n for k, n in counts.items())


def test_pii_weak_labels_add_what_context_supports(spark):
    rows = [(i, f"please call +1 (415) 555-{1000 + i} or phone 415-555-{2000 + i} now") for i in range(200)] + [(1000 + i, f"version 4.{i}.2.1 order 123-456-{1000 + i}") for i in range(50)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all([s["kind"] for s in got[i]] == ["phone", "phone"] for i in range(200))
    assert all(s["strict"] for i in range(50) for s in got[1000 + i])


def test_pii_awkward(spark, awkward):
    got = pii.find_pii(awkward).collect()
    assert len(got) == len(AWKWARD) and all(r["spans"] == [] for r in got)
    assert pii.find_pii(awkward.limit(0)).count() == 0


# Mixing.


def test_mixing_meets_targets(spark):
    r = random.Random(3)
    kinds = ["alpha beta gamma", "delta epsilon zeta", "eta theta iota", "kappa lambda mu"]
    rows = [(i, " ".join(r.choice(kinds[i % 4].split()) for _ in range(r.randint(5, 60)))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 in (0, 2)), int(i % 4 > 1)) for i in range(400)], "doc_id bigint, quality int, toxic int")
    targets = (0.5, 0.3, 0.15, 0.05)
    got = mixing.mix(docs, labels, targets=targets).collect()
    total = sum(x["n_tokens"] for x in got)
    for k, t in enumerate(targets):
        assert sum(x["rate"] * x["n_tokens"] * x["posterior"][k] for x in got) / total == pytest.approx(t, abs=1e-4)
    assert all(x["rate"] >= 0 for x in got)
    # quality is 1 for kinds 0 and 2, toxic for kinds 2 and 3: domains 0, 1, 2, 3 in the operator's order.
    assert sum(x["posterior"][x["doc_id"] % 4] > 0.5 for x in got) > 700


def spread_posteriors(spark, alphas, n=4000):
    r = np.random.default_rng(0)
    p, tokens = r.dirichlet(alphas, n), r.integers(20, 500, n)
    rows = spark.createDataFrame([(int(t), row) for t, row in zip(tokens, p.tolist())], "n_tokens bigint, posterior array<double>")
    return p, tokens / tokens.sum(), rows


def test_rates_meet_skewed_targets(spark):
    p, w, rows = spread_posteriors(spark, (0.5, 2, 0.2, 0.2))
    fitted = mixing.fit_rates(rows, mixing.TARGETS)
    got = mixing.with_rates(rows, fitted).collect()
    rate = np.array([x["rate"] for x in got])
    p, w = np.array([x["posterior"] for x in got]), np.array([x["n_tokens"] for x in got])
    assert fitted.optimal and rate.min() >= 0
    assert (p * (rate * w / w.sum())[:, None]).sum(0) == pytest.approx(mixing.TARGETS, abs=1e-5)


def test_rates_are_optimal_where_targets_cannot_be_met(spark):
    p, w, rows = spread_posteriors(spark, (0.3, 3, 0.3, 0.3))
    fitted = mixing.fit_rates(rows, mixing.TARGETS)
    rate, _ = mixing.rates_of(p, fitted.mu, fitted.steps)
    left = np.array(mixing.TARGETS) - (p * (rate * w)[:, None]).sum(0)
    assert fitted.optimal and np.abs(left).max() > 0.01 and fitted.left == pytest.approx(left.tolist(), abs=1e-6)
    # No rate gains by a gradient step: those above 0 have no slope, those at 0 none upwards.
    assert np.abs(rate - np.maximum(rate + p @ left, 0)).max() < 1e-5


def test_projected_gradients_alone_reach_the_same(spark):
    p, w, rows = spread_posteriors(spark, (4, 2, 1, 1), 300)
    fitted = mixing.fit_rates(rows, (0.4, 0.3, 0.2, 0.1), tolerance=1e-3, start=0)
    got = mixing.with_rates(rows, fitted).collect()
    assert fitted.optimal and fitted.steps and set(fitted.mu) == {0.0}
    assert [x["rate"] for x in got] == pytest.approx(mixing.rates_of(p, fitted.mu, fitted.steps)[0].tolist())
    assert (p * (mixing.rates_of(p, fitted.mu, fitted.steps)[0] * w)[:, None]).sum(0) == pytest.approx((0.4, 0.3, 0.2, 0.1), abs=2e-2)


def test_mixing_awkward(spark, awkward, labels):
    got = mixing.mix(awkward, labels).collect()
    assert len(got) == len(AWKWARD) and all(x["rate"] >= 0 and sum(x["posterior"]) == pytest.approx(1) for x in got)
    assert mixing.mix(awkward.limit(0), labels).count() == 0
    assert mixing.mix(awkward, labels.limit(0)).count() == len(AWKWARD)


# Secrets.


def test_secrets_equal_brute_force(spark, sf):
    r = random.Random(5)
    bits = ["token", "Secret", "pass", "word", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "x", "é", "\n", "+/", "é"]
    odd = [(10_000 + k, "".join(r.choice(bits) for _ in range(r.randint(0, 14)))) for k in range(1500)]
    docs = table(spark, sf, "documents").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id bigint, text string"))
    texts = {x["doc_id"]: x["text"] for x in docs.collect()}
    for x in secrets.find_secrets(docs).collect():
        assert [(s["start"], s["kind"], s["end"]) for s in x["spans"] if s["kind"] != "random"] == secrets.brute_force(texts[x["doc_id"]]), texts[x["doc_id"]]


def test_randomness_battery_tells_keys_from_words(spark):
    r = random.Random(4)
    key = lambda n: base64.b64encode(r.randbytes(n)).decode()
    rows = [(i, f"key is {key(30)} é end") for i in range(60)] + [(100 + i, "see /usr/local/lib/python3/something/else and thnttionbleingandthenanother1 aa20260101-20260102-20260103-20260104") for i in range(40)]
    got = {x["doc_id"]: [s["kind"] for s in x["spans"]] for x in secrets.find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got[i] == ["random"] for i in range(60)) >= 56 and not any(got[100 + i] for i in range(40))


def test_secrets_awkward(spark, awkward):
    got = secrets.find_secrets(awkward).collect()
    assert len(got) == len(AWKWARD) and all(r["spans"] == [] for r in got)
    assert secrets.find_secrets(awkward.limit(0)).count() == 0


# Quality classifier.


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = quality.classify(table(spark, d, "documents"), table(spark, d, "labels")).join(table(spark, d, "labels"), "doc_id").where("held_out")
    assert got.where("predicted = quality").count() > 0.95 * got.count()
    good = got.where("quality = 1")
    assert good.where("predicted = 1").count() >= 0.99 * good.count()


def test_quality_awkward(spark, awkward, labels):
    got = quality.classify(awkward, labels).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert quality.classify(awkward.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.classify(awkward, labels.limit(0)).collect()} == {0.5}


# Near-duplicates.


def jaccard_components(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = word_list(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("limit", [1000, 4])
def test_near_duplicates_equal_brute_force(spark, limit):
    r = random.Random(6)
    rows, at = [], 0
    for g in range(12):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([3, 30, 120]))]
        for _ in range(r.choice([1, 4, 25])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = f"v{r.randint(0, 9999)}"
            rows.append((at, " ".join(w).upper() if at % 2 else "  ".join(w)))
            at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, " ")]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), node_limit=limit).collect()}
    assert got == jaccard_components(rows)


def test_near_duplicates_awkward(spark, awkward):
    got = neardup.near_duplicates(awkward).collect()
    by = {r["doc_id"]: r for r in got}
    assert sum(r["doc_id"] == 5 for r in got) == 1 and by[6]["component_id"] == 5 and not by[6]["kept"] and by[None]["kept"]
    assert by[1]["component_id"] == 1 and by[9]["component_id"] == 9
    assert neardup.near_duplicates(awkward.limit(0)).count() == 0
    kept = neardup.one_of_each(spark, awkward, "")
    assert kept.columns == awkward.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter({i for i, _ in AWKWARD} - {6})


# Decontamination.


def test_suffix_array_finds_longest_matches(spark):
    item = " ".join(f"q{k}" for k in range(40))
    docs = [(1, "a b " + " ".join(f"q{k}" for k in range(5, 30)) + " c"), (2, " ".join(f"q{k}" for k in range(9))), (3, "Short ITEM"), (4, "a short, item!"), (5, None), (None, item), (6, item + " " + item)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("items", F.lit(1))
    bench = spark.createDataFrame([("i", item), ("s", "short item"), ("n", None), ("e", " ! ")], "item_id string, text string")
    for block in (16_000_000, 100):
        got = {r["doc_id"]: r for r in decontam.decontaminate(df, bench, block_bytes=block).collect()}
        assert (got[1]["longest"], got[1]["longest_at"], got[1]["items"]) == (25, 2, ["i"])
        assert got[2]["longest"] == 0 and got[3]["items"] == ["s"] and got[4]["items"] == ["s"] and got[5]["n_words"] == 0
        assert got[None]["longest"] == 40 and [(s["start"], s["end"]) for s in got[6]["spans"]] == [(0, 80)]
        assert sorted(str(r["doc_id"]) for r in decontam.without(df, bench, block_bytes=block).collect()) == ["2", "5"]
    assert decontam.decontaminate(df, bench.limit(0)).where(F.size("spans") > 0).count() == 0
    assert decontam.decontaminate(df.limit(0), bench).count() == 0


def test_suffix_array_order():
    r = np.random.default_rng(0)
    ids = r.integers(0, 3, 400).astype(np.uint64)
    order, _ = decontam.suffix_array(ids, 400)
    assert order.tolist() == sorted(range(400), key=lambda i: ids[i:].tolist())


# Pipeline.


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs = table(spark, sf, "documents")
    out = p.run(spark, sf)
    assert [n for n, _ in p.STAGES] == ["quality_classifier", "near_duplicates", "decontamination", "secret_redaction", "target_mixing"]
    kept = {r["doc_id"]: r for r in out.collect()}
    assert 0 < len(kept) < docs.count() and set(docs.columns) <= set(out.columns)
    # The stages in plain Python: scores from the classifier itself, the rest by brute force.
    good = {r["doc_id"]: r["text"] for r in quality.keep_good(spark, docs, sf).collect()}
    comp = jaccard_components(list(good.items()))
    left = {i: t for i, t in good.items() if comp[i][1] == i}
    bench = [word_list(r["text"], r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+") for r in table(spark, sf, "benchmark").collect()]
    grams = {tuple(w[k : k + min(10, len(w))]) for w in bench if w for k in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(g) for g in grams}

    def dirty(t):
        w = word_list(t, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        return any(tuple(w[k : k + n]) in grams for n in sizes for k in range(len(w) - n + 1))

    clean = {i for i, t in left.items() if not dirty(t)}
    assert set(kept) == clean
    assert not any(secrets.brute_force(r["text"]) for r in kept.values())
    assert all(len(r["text"]) == r["n_chars"] and r["rate"] >= 0 for r in kept.values())
