import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.functions import tokens as T
from tokenloom.operators import components as C
from tokenloom.operators import connections as N
from tokenloom.operators import intervals, metrics, partitioning, spectral, trees
from tokenloom.plans import programs
from tokenloom.sources import generators
from tokenloom.sources import records as R


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@settings(max_examples=40, deadline=None)
@given(st.text("ACGTN", max_size=60), st.integers(1, 31))
def test_tokens_of_equals_strings(s, k):
    at, codes = T._tokens_of(np.frombuffer(s.encode() + b"\n", np.uint8), k, False)
    want = [(i, min(s[i : i + k], rc(s[i : i + k]))) for i in range(len(s) - k + 1) if "N" not in s[i : i + k]]
    assert [(int(i), "".join("ACGT"[int(c) >> 2 * (k - 1 - j) & 3] for j in range(k))) for i, c in zip(at, codes)] == want


def test_token_expressions(spark):
    df = spark.createDataFrame([("ACGTTGCA",), ("AC",), ("",), (None,)], "s string")
    out = df.select(F.transform(T.windows(F.col("s"), 3), T.canonical).alias("w"), T.unpacked(T.packed(F.col("s")), 8).alias("u")).collect()
    assert out[0]["w"] == [min(w, rc(w)) for w in ("ACG", "CGT", "GTT", "TTG", "TGC", "GCA")]
    assert out[0]["u"] == "ACGTTGCA" and out[1]["w"] == [] and out[2]["w"] == []


def test_quality_windows_two_ways(spark):
    df = spark.createDataFrame([(1, "IHGA!J"), (2, "II"), (3, None)], "read_id bigint, qualities string")
    a = T.quality_rows(df, 3).orderBy("pos").collect()
    b = df.where("read_id = 1").select(T.quality_windows(F.col("qualities"), 3).alias("q")).first()["q"]
    assert [(r["low"], r["mean"]) for r in a] == [(r["low"], r["mean"]) for r in b]


def test_tokeniser_edges(spark):
    df = spark.createDataFrame([(1, 0, "ACGTN"), (2, 0, None), (3, 1, ""), (4, 1, "ANA")], "read_id bigint, category_id int, sequence string")
    assert T.tokenise(df, 3).count() == 2
    assert T.tokenise(df, 3, n_as_a=True).count() == 4
    with pytest.raises(ValueError):
        T.tokenise(df, 32)


def graph(seed, n=30, m=45):
    r = random.Random(seed)
    return sorted({(x, y): r.randint(1, 9) for x, y in (sorted(r.sample(range(n), 2)) for _ in range(m))}.items())


def parts(edges):
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    kept = []
    for (x, y), w in sorted(edges, key=lambda e: (-e[1], e[0])):
        a, b = find(x), find(y)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((x, y, w))
    return {v: find(v) for v in root}, sorted(kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_forest(spark, seed):
    e = graph(seed)
    df = spark.createDataFrame([(x, y, w) for (x, y), w in e], "x bigint, y bigint, score bigint")
    comp, forest = parts(e)
    assert {r["id"]: r["component_id"] for r in C.connected_components(df).collect()} == comp
    assert sorted((r["x"], r["y"], r["score"]) for r in trees.spanning_forest(df).collect()) == forest


def test_long_chain(spark):
    df = spark.range(300).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    assert C.connected_components(df).select("component_id").distinct().collect()[0][0] == 0


def test_no_edges(spark):
    none = spark.createDataFrame([], "x bigint, y bigint, score bigint")
    assert C.connected_components(none).count() == 0 and trees.spanning_forest(none).count() == 0


def test_bounded_components(spark):
    df = spark.createDataFrame([(1, 2, 9), (2, 3, 8), (3, 4, 7), (4, 5, 6)], "x bigint, y bigint, score bigint")
    got = {r["read_id"]: r["component_id"] for r in C.bounded_components(df, 2).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_top_fraction_cuts_ties_in_order(spark):
    df = N.mirrored(spark.createDataFrame([(1, 2, 5), (1, 3, 5), (2, 3, 5)], "x bigint, y bigint, score bigint"))
    got = N.top_fraction(df, 0.5).collect()
    assert sorted((r["x"], r["y"]) for r in got) == [(1, 2), (1, 3), (2, 1)]


def test_interval_union_keeps_touching_apart(spark):
    df = spark.createDataFrame([(0, 1, 5), (0, 4, 8), (0, 8, 9), (1, 3, 4)], "k int, start bigint, end bigint")
    got = sorted((r["k"], r["start"], r["end"]) for r in intervals.interval_union(df, ["k"]).collect())
    assert got == [(0, 1, 8), (0, 8, 9), (1, 3, 4)]
    cover = {(r["k"], r["depth"]): r["bases"] for r in intervals.coverage_histogram(df, ["k"]).collect()}
    assert sum(d * n for (_, d), n in cover.items()) == 4 + 4 + 1 + 1


def test_tails_of_a_path(spark):
    tree = spark.createDataFrame([(i, i + 1, 10) for i in range(1, 20)], "x bigint, y bigint, overlap bigint")
    lengths = spark.createDataFrame([(i, 100) for i in range(1, 21)], "read_id bigint, length bigint")
    got = trees.tails(tree, lengths, 100).collect()
    assert {r["read_id"] for r in got if r["side"] == "R"} == {1, 2, 3} and {r["read_id"] for r in got if r["side"] == "L"} == {18, 19, 20}


def planted(groups=3, each=6):
    return [(a, b, 50 if a // each == b // each else 1) for a in range(groups * each) for b in range(a + 1, groups * each) if a // each == b // each or (a + b) % 7 == 0]


def test_spectral_finds_planted_groups(spark):
    df = spark.createDataFrame(planted(), "x bigint, y bigint, score bigint")
    got = {}
    for r in spectral.spectral_clusters(df, 6).collect():
        got.setdefault(r["cluster"], set()).add(r["read_id"])
    assert sorted(map(sorted, got.values())) == [list(range(6 * k, 6 * k + 6)) for k in range(3)]


def test_spectral_without_a_dense_matrix(spark):
    df = spark.createDataFrame(planted(3, 12), "x bigint, y bigint, score bigint")
    lap = spectral.normalised(spectral.affinity(df))
    m = lap.toPandas().pivot(index="i", columns="j", values="w").fillna(0).to_numpy()
    vectors, values = spectral.leading(lap, 4)
    assert np.allclose(values, np.linalg.eigvalsh(m)[::-1][:4], atol=1e-6)
    v = np.array([r["v"] for r in vectors.orderBy("i").collect()])
    assert np.abs(m @ v - v * values).max() < 1e-3 and np.allclose(v.T @ v, np.eye(4), atol=1e-6)
    got = {}
    for r in spectral.spectral_clusters(df, 6, dense=10).collect():
        got.setdefault(r["cluster"], []).append((r["rank"], r["read_id"]))
    assert sorted(sorted(i for _, i in g) for g in got.values()) == [list(range(12 * k, 12 * k + 12)) for k in range(3)]
    assert all(sorted(k for k, _ in g) == list(range(12)) for g in got.values())


def test_bisection_finds_planted_halves(spark):
    df = spark.createDataFrame(planted(2), "x bigint, y bigint, score bigint")
    for narrow in (None, 3):
        a, b, cost = partitioning.bisect(df, narrow=narrow)
        assert {min(a) // 6, max(a) // 6, min(b) // 6, max(b) // 6} == {0, 1} and len(a) == len(b) == 6
        side = spark.createDataFrame([(v, int(v in a)) for v in a | b], "read_id bigint, side int")
        assert partitioning.cut_cost(df, side).first()["cost"] == cost


def test_prominent_peaks():
    assert metrics.prominent_peaks([0, 5, 1, 1, 9, 0]) == [1, 4]
    assert metrics.prominent_peaks([]) == [] and metrics.prominent_peaks([3, 3, 3]) == []


def test_files_round_trip(spark, tmp_path):
    fastq = tmp_path / "a.fastq"
    fastq.write_text("@r1;length=4bp;startpos=7;x\nACGT\n+\nIIII\n@r2;length=2bp;startpos=0;x\nGG\n+\nII\n")
    fasta = tmp_path / "b.fasta"
    fasta.write_text(">g one\nACGT\nAC\n>g two\nTTTT\n")
    got = sorted(R.read_records(spark, [str(fastq), str(fasta)]).collect())
    assert [(r["read_id"], r["sequence"], r["category_id"], r["start"], r["end"]) for r in got] == [(1, "ACGT", 0, 7, 11), (2, "GG", 0, 0, 0), (3, "ACGTAC", 1, 0, 0), (4, "TTTT", 1, 0, 0)]
    R.write_records(R.read_records(spark, [str(fastq)]), str(tmp_path / "out"), "fastq")
    again = R.read_fastq(spark, str(tmp_path / "out"))
    assert sorted(r["sequence"] for r in again.collect()) == ["ACGT", "GG"]
    with pytest.raises(ValueError):
        (tmp_path / "c").write_text("nothing\n")
        R.sniff(spark, str(tmp_path / "c"))
    (tmp_path / "k").write_text("TTT\nACG\nAAA\n")
    tokens, k = R.read_token_list(spark, str(tmp_path / "k"))
    assert k == 3 and sorted(r["kmer"] for r in tokens.collect()) == ["AAA", "ACG"]


def test_generated_reads_come_from_the_genome(spark):
    g = generators.genome_pair(spark, 3000, 0.1).cache()
    genome = "".join(r["a"] for r in g.orderBy("pos").collect())
    diff = g.where("a <> b").count()
    assert 200 < diff < 400
    pieces = generators.assembled(g, "a", 500)
    for r in generators.uniform_reads(spark, pieces, 3000, 2, 100, chunk=500).collect():
        own = genome[r["start"] : r["end"]]
        assert r["sequence"] in (own, rc(own))


def test_grouping_separates_two_genomes(spark):
    """Reads of two unrelated genomes, grouped by the tokens they share, come out by genome."""
    own = []
    for k, seed in ((0, 5), (1, 50)):
        pieces = generators.assembled(generators.genome_pair(spark, 2000, 0.0, seed), "a", 400)
        r = generators.uniform_reads(spark, pieces, 2000, 8, 200, category_id=k, seed=seed + 3, chunk=400)
        own.append(r.withColumn("read_id", F.col("read_id") + 1000 * k))
    records = own[0].unionByName(own[1]).cache()
    found = programs.select_tokens(records, 3, 30, k=15, singleton_scope="none")
    groups = programs.group_records(records, found.tokens.select("token"), 15, programs.Settings(min_size=5, score=30, enrichment=10)).components
    purity = metrics.component_purity(groups, records).collect()
    assert purity and all(r["purity"] == 1.0 for r in purity) and sum(r["size"] for r in purity) > 0.8 * records.count()


def test_records_of_few_occurrences_make_scaffolds(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    a, b = word(15), word(15)
    texts = ["".join(w + word(15) for _ in range(n)) for w, n in ((a, 5), (a, 5), (b, 4), (b, 5))]
    records = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "read_id bigint, category_id int, sequence string")
    tokens = T.tokenise(records, 15).groupBy("token").count().where("count > 8").select("token")
    # Five times five occurrences are above 20 though neither record has 20; four times five are not.
    groups = programs.group_records(records, tokens, 15, programs.Settings(min_size=2, score=20))
    assert sorted(map(tuple, groups.scaffolds.select("component_id", "read_id").collect())) == [(0, 0), (0, 1)]


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    from tokenloom.operators.counting import counts_by_category
    from tokenloom.streaming import counts as S

    df = spark.createDataFrame([(i, "ACGTACGTTTGACA"[i % 5 :], i % 2) for i in range(20)], "read_id bigint, sequence string, category_id int")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    q = S.counted_into(S.record_stream(spark, str(tmp_path / "in"), files_per_batch=1), 5, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("token", "category_id").agg(F.sum("cnt").alias("cnt"))
    key = lambda rows: sorted((r["token"], r["category_id"], r["cnt"]) for r in rows)
    assert key(got.collect()) == key(counts_by_category(df, 5).collect())


def test_folders_of_files_keep_their_records(spark, tmp_path):
    """Splits of several files come in any order; each line is numbered within its own file."""
    r = random.Random(1)
    want = []
    (tmp_path / "fq").mkdir()
    for f, n in (("a", 400), ("b", 700), ("c", 3)):
        own = [(f"{f}{i}", "".join(r.choice("ACGT") for _ in range(r.randint(0, 120)))) for i in range(n)]
        (tmp_path / "fq" / f"{f}.fastq").write_text("".join(f"@{h}\n{s}\n+\n{'@' * len(s)}\n" for h, s in own) + ("@cut\nAC\n" if f == "a" else ""))
        want += own
    (tmp_path / "x.fasta").write_text("".join(f">x{i}\n{'ACGT' * (i % 7)}\n{'GG' * (i % 3)}\n" for i in range(500)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        got = R.read_fastq(spark, str(tmp_path / "fq")).orderBy("n").collect()
        both = R.read_records(spark, [str(tmp_path / "x.fasta"), str(tmp_path / "fq")]).orderBy("read_id").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [(x["header"], x["sequence"]) for x in got] == want and all(x["qualities"] == "@" * len(x["sequence"]) for x in got)
    assert [x["read_id"] for x in both] == list(range(1, 501 + len(want)))
    assert [(x["header"], x["category_id"]) for x in both] == [(f"x{i}", 0) for i in range(500)] + [(h, 1) for h, _ in want]
    assert both[5]["sequence"] == "ACGT" * 5 + "GG" * 2


def test_distances_are_whole_or_an_error(spark):
    path = spark.createDataFrame([(i, i + 1, 10) for i in range(9)], "x bigint, y bigint, overlap bigint")
    lengths = spark.createDataFrame([(i, 100) for i in range(10)], "read_id bigint, length bigint")
    want = {i: (0, 100 + 90 * i) for i in range(10)}
    key = lambda df: {r["read_id"]: (r["root"], r["distance"]) for r in df.collect()}
    roots = spark.createDataFrame([(0,)], "read_id bigint")
    assert key(trees.distances(path, roots, lengths)) == want == key(trees.rooted_distances(path, lengths))
    with pytest.raises(RuntimeError):
        trees.distances(path, roots, lengths, max_rounds=3)
    with pytest.raises(RuntimeError):
        trees.rooted_distances(spark.createDataFrame([(1, 2, 0), (2, 1, 0), (3, 1, 0)], "x bigint, y bigint, overlap bigint"), lengths, max_rounds=5)
    with pytest.raises(RuntimeError):
        trees.spanning_forest(path.select("x", "y", F.col("overlap").alias("score")), max_rounds=0)


def test_few_edges_and_many_give_the_same_components(spark):
    r = random.Random(3)
    e = spark.createDataFrame([(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(1, 1), (None, 5)], "x bigint, y bigint")
    assert sorted(C.connected_components(e).collect()) == sorted(C.connected_components(e, few=0).collect())


def test_ranges_of_a_hot_key_unite_as_one(spark):
    r = random.Random(4)
    rows = [(k, s, s + r.randint(1, 9)) for k in (0, None) for s in (r.randint(0, 900) for _ in range(300))]
    got = sorted((str(x["k"]), x["start"], x["end"]) for x in intervals.interval_union(spark.createDataFrame(rows, "k int, start bigint, end bigint"), ["k"]).collect())
    want = []
    for k in (0, None):
        own = []
        for _, s, e in sorted(x for x in rows if x[0] == k) if k == 0 else sorted((x for x in rows if x[0] is None), key=lambda x: x[1:]):
            if own and s < own[-1][2]:
                own[-1] = (str(k), own[-1][1], max(own[-1][2], e))
            else:
                own.append((str(k), s, e))
        want += own
    assert got == sorted(want)


def test_shares_of_near_ids_are_independent(spark):
    x = [r["h"] for r in spark.range(20000).select(T.hash_share(F.col("id")).alias("h")).collect()]
    assert abs(np.mean(x) - 0.5) < 0.01 and abs(np.corrcoef(x[1:], x[:-1])[0, 1]) < 0.03


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace as O

    from tokenloom.sources.shared import shared_dir

    session = lambda master, path: O(sparkContext=O(master=master, getConf=lambda: O(get=lambda k: path)), conf=O(get=lambda k, d=None: d))
    assert shared_dir(session("yarn", "hdfs:///x/")) == "hdfs:///x" and shared_dir(session("local[4]", None)).startswith("file:")
    with pytest.raises(RuntimeError):
        shared_dir(session("spark://host:7077", None))


def test_expression_tokens_across_blocks(spark):
    from tokenloom.functions.tokens import code_string, expression_tokens

    r = random.Random(6)
    texts = ["".join(r.choice("ACGT") for _ in range(n)) for n in (0, 6, 7, 63, 64, 65, 69, 70, 71, 134, 500)]
    rows = expression_tokens(spark.createDataFrame(list(enumerate(texts)), "read_id long, sequence string"), 7).select("read_id", code_string(F.col("code"), 7).alias("t")).collect()
    for i, s in enumerate(texts):
        assert sorted(x["t"] for x in rows if x["read_id"] == i) == sorted(min(s[j : j + 7], rc(s[j : j + 7])) for j in range(len(s) - 6))


def test_tokens_dealt_by_minimizers_equal_rows_of_tokens(spark):
    from tokenloom.functions.tokens import tokenise
    from tokenloom.operators import connections as N
    from tokenloom.operators import counting as K
    from tokenloom.operators import shards as S

    r = random.Random(3)
    word = lambda n, letters="ACGT": "".join(r.choice(letters) for _ in range(n))
    common = [word(40) for _ in range(12)] + ["A" * 60, "ACACACAC" * 9, rc(word(40))]
    rows = [(i, i % 3 if i % 7 else None, "".join(r.choice([*common, word(9), word(30, "ACGTN")]) for _ in range(r.randrange(9)))) for i in range(60)]
    records = spark.createDataFrame([*rows, (60, 1, None), (61, 2, ""), (62, 0, word(18)), (2**40, 0, common[0] * 2), (2**40 + 1, 1, common[0])], "read_id bigint, category_id int, sequence string").repartition(3)
    sorted_rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    for k in (13, 19, 31):
        occ = tokenise(records, k)
        totals = occ.groupBy("token").count()
        assert sorted_rows(S.totals(records, k)) == sorted_rows(totals)
        band = totals.where("count BETWEEN 4 AND 12").select("token")
        own = occ.join(band, "token", "left_semi").select("read_id", "category_id", "pos", "token")
        assert sorted_rows(own) == sorted_rows(S.band_occurrences(records, k, 4, 12)) != []
        assert sorted_rows(N.pairs(N.multiplicities(own), min_score=3)) == sorted_rows(S.band_pairs(records, k, 4, 12, min_score=3)) != []
        counts = K.counts_by_category(records, k)
        both = counts.join(totals.withColumnRenamed("count", "total"), "token").groupBy("cnt", "total").count()
        assert sorted_rows(both) == sorted_rows(S.profile(records, k))



def test_dealt_tokens_take_few_bytes(spark):
    from tokenloom.operators import shards as S

    r = random.Random(4)
    records = spark.createDataFrame([(i, 0, "".join(r.choice("ACGT") for _ in range(20_000))) for i in range(100)], "read_id bigint, category_id int, sequence string").coalesce(1)
    sent = S.dealt(records, 19, ("read_id", "category_id")).selectExpr("sum(length(blob)) AS n").first()["n"]
    assert sent < 3 * 100 * 20_000


def test_distinct_tokens_of_several_lengths(spark):
    from tokenloom.operators import counting as K

    r = random.Random(9)
    texts = ["".join(r.choice("ACGT") for _ in range(r.randint(0, 90))) for _ in range(60)] + ["A" * 200, "ACGT" * 30, "ACGTN" * 12 + "ACGTACGTTGCATCGATTACGGA", "", None]
    texts += [rc(t) for t in texts[:20]]
    df = spark.createDataFrame([(t,) for t in texts], "sequence string").repartition(3)
    ks = [3, 11, 12, 13, 14, 15, 16, 17, 31]
    want = {k: len({min(w, rc(w)) for t in texts if t for i in range(len(t) - k + 1) if "N" not in (w := t[i : i + k])}) for k in ks}
    assert {x["k"]: x["distinct_kmers"] for x in K.distinct_by_k(df, ks).collect()} == want
    assert {x["k"]: x["distinct_kmers"] for x in K.distinct_by_k(df.where("sequence IS NULL"), [11, 13, 15]).collect()} == {11: 0, 13: 0, 15: 0}
    assert {k: K.distinct_by_k(df, [k]).first()["distinct_kmers"] for k in (13, 15, 31)} == {k: want[k] for k in (13, 15, 31)}
    plan = K.distinct_by_k(df, ks)._jdf.queryExecution().executedPlan().toString()
    # No exchange carries rows of tokens.
    assert "hashpartitioning(token" not in plan and "keys=[token" not in plan
    with pytest.raises(ValueError):
        K.distinct_by_k(df, [33]).collect()


def test_overlaps_of_shards_equal_those_of_rows(spark):
    from tokenloom.operators import shards as S

    r = random.Random(4)
    base = "".join(r.choice("ACGT") for _ in range(400))
    texts = [base[r.randint(0, 150) : r.randint(200, 400)] + "".join(r.choice("ACGT") for _ in range(20)) for _ in range(12)] + [base[:60] * 2, rc(base), None, "ACG"]
    df = spark.createDataFrame([(None if i == 3 else i, 0, t) for i, t in enumerate(texts)], "read_id bigint, category_id int, sequence string").repartition(3)
    occ = T.tokenise(df, 15)
    band = occ.groupBy("token").count().where("count BETWEEN 2 AND 9").select("token")
    occ = occ.join(band, "token")
    want = N.overlap_estimates(N.pairs(N.multiplicities(occ), min_score=5), N.first_positions(occ))
    got = S.band_overlaps(df, 15, 2, 9, min_score=5)
    rows = sorted(map(tuple, got.collect()))
    assert len(rows) > 20 and rows == sorted(map(tuple, want.collect()))
    # A record without an id is linked with none.
    assert sorted(x[:3] for x in rows) == sorted(map(tuple, S.band_pairs(df, 15, 2, 9, min_score=5).collect()))


def test_bloom_places_of_arrays_are_those_of_columns(spark):
    from tokenloom.operators import sketches

    r = random.Random(3)
    tokens = [0, 1, -1, 2**62 - 1, -(2**63)] + [r.randrange(4**19) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in tokens], "token bigint")
    for bits, hashes in ((64, 3), (1 << 20, 7), (4, 2)):
        want = {x["token"]: x["p"] for x in df.select("token", sketches.bit_positions(F.col("token"), bits, hashes).alias("p")).collect()}
        got = np.stack(list(sketches.bit_places(np.array(tokens), bits, hashes)), axis=1)
        assert [want[t] for t in tokens] == got.tolist()
    words = sketches.bloom(df.limit(60), 1024, 5).localCheckpoint()
    want = {x["token"]: x["maybe"] for x in sketches.bloom_contains(df, words, 1024, 5).collect()}
    got = sketches.maybe_in(np.array(tokens), sketches.filter_bytes(words, 1024), 1024, 5)
    assert [want[t] for t in tokens] == got.tolist() and not got.all() and got.any()


def test_counts_of_packed_tokens_are_written_in_order(spark, tmp_path):
    r = random.Random(8)
    rows = [(r.randrange(4**6), r.randint(1, 9)) for _ in range(300)]
    df = spark.createDataFrame(rows, "token bigint, cnt bigint").repartition(5)
    R.write_counts(df, f"{tmp_path}/packed", k=6, compression="gzip")
    R.write_counts(df.select(T.unpacked(F.col("token"), 6).alias("kmer"), "cnt"), f"{tmp_path}/strings")
    lines = lambda p: [x["value"] for f in sorted((tmp_path / p).glob("part-*")) for x in spark.read.text(str(f)).collect()]
    assert [x.split()[0] for x in lines("packed")] == sorted(x.split()[0] for x in lines("strings")) == [x.split()[0] for x in lines("strings")]
    assert all(f.suffix == ".gz" for f in (tmp_path / "packed").glob("part-*"))
    assert sorted(map(tuple, R.read_counts(spark, f"{tmp_path}/packed").collect())) == sorted(map(tuple, R.read_counts(spark, f"{tmp_path}/strings").collect()))


def test_pairs_are_dealt_without_places(spark):
    from tokenloom.operators import shards as S

    r = random.Random(2)
    df = spark.createDataFrame([(i, "".join(r.choice("ACGT") for _ in range(20_000))) for i in range(8)], "read_id bigint, sequence string").coalesce(1)
    size = lambda **x: S.dealt(df, 19, ("read_id",), **x).agg(F.sum(F.length("blob"))).first()[0]
    # A place takes about a byte and a half of the stretch's nine.
    assert size(places=False) < 0.85 * size()


def test_pairs_go_to_their_sums_as_differences(spark, monkeypatch):
    from tokenloom.operators import shards as S

    r = random.Random(3)
    far = [0, 1, 5, -7, 2**62, -(2**62), 2**62 + 1, *range(1000, 1060)]
    texts = ["".join(r.choice("ACGT") for _ in range(r.randrange(60))) for _ in range(40)]
    rows = [(i, "".join(r.sample(texts, 8))) for i in far] + [(None, texts[0])]
    df = spark.createDataFrame(rows, "read_id bigint, sequence string").repartition(3)
    want = {}
    tokens = {i: Counter(min(s[j : j + 19], rc(s[j : j + 19])) for j in range(len(s) - 18)) for i, s in rows}
    total = sum(tokens.values(), Counter())
    for n, a in enumerate(sorted(far)):
        for b in sorted(far)[n + 1 :]:
            score = sum(m * tokens[b][t] for t, m in tokens[a].items() if t in tokens[b] and 4 <= total[t] <= 12)
            if score:
                want[a, b] = score
    assert len(want) > 100
    for pairs in (S._PAIRS, 50):  # all pairs at once; many small sends
        monkeypatch.setattr(S, "_PAIRS", pairs)
        for least in (1, 20):
            got = S.band_pairs(df, 19, 4, 12, min_score=least).collect()
            assert len(got) == len({(x.x, x.y) for x in got})
            assert {(x.x, x.y): x.score for x in got} == {p: v for p, v in want.items() if v >= least}

    many = spark.createDataFrame([(i, "".join(r.sample(texts, 8))) for i in range(400)], "read_id bigint, sequence string").coalesce(1)
    monkeypatch.undo()
    parts = S.dealt_pairs(many, 19, 4, 100).agg(F.sum("n").alias("n"), F.sum(F.length("blob")).alias("size")).first()
    assert parts["n"] > 10_000 and parts["size"] < 5 * parts["n"]  # 24 as numbers


def test_packed_pairs_are_read_back():
    from tokenloom.operators import shards as S

    r = np.random.default_rng(4)
    ends = np.array([-(2**63) + 1, -3, 0, 0, 1, 2**40, 2**63 - 1])
    for n in (0, 1, 2, 500):
        for draw in (lambda: r.integers(0, 9, n), lambda: r.choice(ends, n)):
            x, y, score = S._summed(draw(), draw(), r.geometric(0.4, n) ** r.integers(1, 9, n))
            size, blob = S._packed_pairs(x, y, score)
            assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(S._unpacked_pairs(len(x), size, blob), (x, y, score)))
