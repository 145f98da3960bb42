import numpy as np
import pytest
from pyspark.sql import functions as F
from rankforge.operators import balance, fusion, information, neighbours, prep, rankers
from rankforge.functions import fusing
from rankforge.plans import ensemble
from rankforge.plans.ensemble import EnsembleRanker
from rankforge.sources import io
from rankforge.sources.schema import DATASETS, Dataset, by_file_name

# The sampling example (f0, f1, f2, label).
ROWS = [(0, 1, 0, 1), (0, 2, 1, 1), (3, 1, 0, 1), (4, 2, 0, 1), (3, 2, 1, 1), (4, 1, 0, 0), (6, 1, 1, 0), (5, 2, 0, 0), (0, 1, 1, 1), (0, 3, 0, 1), (7, 1, 1, 1), (4, 4, 0, 0), (6, 3, 1, 0)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, 0, float(y), [float(a), float(b), float(c)]) for i, (a, b, c, y) in enumerate(ROWS)], "id long, p int, label double, features array<double>")


def test_nominal(rows):
    got = {r.f: r.is_nominal for r in prep.nominal(prep.to_long(rows, ()), 5).collect()}
    assert got == {0: False, 1: True, 2: True}


@pytest.mark.parametrize(("furthest", "want"), [(False, [0, 2, 3, 4, 5, 6, 7, 10, 11, 12]), (True, [1, 2, 3, 4, 5, 6, 7, 10, 11, 12])])
def test_near_miss(rows, furthest, want):
    got = balance.near_miss(rows, 2, "id", furthest, nominal=[False, True, True])
    assert sorted(r.id for r in got.collect()) == want


def test_smote(rows):
    got = balance.smote(rows, 2, "id", gap=0.3618031071604718).collect()
    assert len(got) == 5 and all(r.label == 0.0 for r in got)
    by_id = {r.id: r for r in rows.collect()}
    for r in got:
        a, b = by_id[r.id].features, by_id[r.n_id].features
        assert r.features == pytest.approx([x + 0.3618031071604718 * (y - x) for x, y in zip(a, b)])
    assert all(set(r.features[1:]) <= {1.0, 2.0, 3.0, 4.0, 0.0} for r in balance.smote(rows, 2, "id", nominal=[False, True, True]).collect())


def test_bagging_and_one_class(rows):
    got = balance.bagging(rows, 3, "id").groupBy("bag", "is_minority").count().collect()
    assert {(r.bag, r.is_minority, r["count"]) for r in got} == {(b, m, 5) for b in range(3) for m in (True, False)}
    assert balance.bagging(rows.filter("label = 1"), 1, "id").count() == 8


def test_spread(rows):
    got = balance.spread_classes(rows.drop("p"), 3, "id").groupBy("label", "p").count().collect()
    for y in (0.0, 1.0):
        sizes = [r["count"] for r in got if r.label == y]
        assert max(sizes) - min(sizes) <= 1
    with pytest.raises(ValueError):
        balance.spread_classes(rows, 0, "id")


@pytest.mark.parametrize(("furthest", "want"), [(False, [10, 15, 30, 40, 41]), (True, [100, 50, 41, 40, 30])])
def test_top_k(spark, furthest, want):
    df = spark.createDataFrame([(i + 1, float(d)) for i, d in enumerate([15, 40, 50, 10, 41, 100, 30])], "id int, dist double")
    assert [r.dist for r in neighbours.top_k(df, "dist", 5, furthest=furthest).orderBy("rank").collect()] == want


def test_blocks_agree_and_short_lists_raise(rows):
    own = rows.withColumn("draw", F.col("id"))
    one, three = (sorted(map(tuple, neighbours.nearest(own, own, 3, blocks=b).select("id", "n_id", "rank").collect())) for b in (1, 3))
    assert one == three
    with pytest.raises(Exception, match="fewer than"):
        neighbours.nearest(own, own, 20, must_have=True).collect()


def test_entropy_example(spark):
    x, y = [0, 0, 1, 1, 2, 2, 2, 0], [0, 0, 0, 1, 1, 1, 1, 0]
    df = spark.createDataFrame([(i, f, b) for i, p in enumerate(zip(x, y)) for f, b in enumerate(p)], "id int, f int, bin int")
    h = {r.f: r.h for r in information.entropies(df).collect()}
    assert h[0] == pytest.approx(1.561278, abs=1e-6) and h[1] == pytest.approx(1.0)
    assert {(r.x, r.y): round(r.v, 6) for r in information.similarity(df, normalised=False).collect()}[(0, 1)] == 0.75
    assert {(r.x, r.y): round(r.v, 6) for r in information.similarity(df).collect()}[(0, 1)] == 0.585645
    assert information.similarity_matrix(np.array([x, y]).T)[0, 1] == pytest.approx(0.585645, abs=1e-6)


def test_relations_and_matrices_agree(spark):
    rng = np.random.default_rng(2)
    bins, z = rng.integers(0, 4, (60, 4)), rng.integers(0, 3, 60)
    df = spark.createDataFrame([(i, int(z[i]), f, int(bins[i, f])) for i in range(60) for f in range(4)], "id int, label int, f int, bin int")
    got = np.zeros((4, 4))
    for r in information.conditional(df).collect():
        got[r.x, r.y] = r.v
    assert np.allclose(got, information.conditional_matrix(bins, z))
    su = information.similarity_matrix(np.column_stack([bins, z]))
    rel = {r.f: r.v for r in information.relevance(df).collect()}
    assert np.allclose([rel[f] for f in range(4)], su[:4, 4])
    one = information.conditional(df.filter("f = 0")).collect()
    assert len(one) == 1


def test_scaling(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (1, 0, 3.0), (2, 0, float("nan")), (0, 1, 5.0), (1, 1, 5.0)], "id int, f int, v double")
    bounds = spark.createDataFrame([(0, 1.0, 3.0), (1, 5.0, 5.0)], "f int, mn double, mx double")
    got = {(r.id, r.f): r.v for r in prep.scale(df, bounds).collect()}
    assert got == {(0, 0): 0.0, (1, 0): 1.0, (2, 0): 0.0, (0, 1): 0.5, (1, 1): 0.5}
    binned = {(r.id, r.f): r.bin for r in prep.discretise(df.filter("NOT isnan(v)"), 10, bounds).collect()}
    assert binned == {(0, 0): 0, (1, 0): 9, (0, 1): 0, (1, 1): 0}
    with pytest.raises(Exception, match="below minimum"):
        prep.discretise(df.filter("NOT isnan(v)"), 10, low=2.0, high=6.0, strict=True).collect()


def test_constant_features(spark):
    """A constant label and constant features: NaN where both are, in relations and matrices alike; QPFS leaves such features out."""
    rng = np.random.default_rng(4)
    bins = rng.integers(0, 4, (80, 5))
    bins[:, 3] = bins[:, 4] = 2
    z = (bins[:, 0] > 1).astype(int)
    su = information.similarity_matrix(np.column_stack([bins, z]))
    assert np.isnan(su[3, 4]) and not np.isnan(su[3, 0]) and not np.isnan(su[5]).any()
    w = rankers.qpfs(su)
    alone = rankers.qpfs(np.delete(np.delete(su, [3, 4], 0), [3, 4], 1))
    assert np.allclose(w[:3], alone) and w[3] == w[4] == alone.min() and w[:3].sum() == pytest.approx(1.0)
    one = rankers.qpfs(np.delete(np.delete(su, 4, 0), 4, 1))  # a single constant is defined, and stays
    assert one.sum() == pytest.approx(1.0)
    same = np.column_stack([bins, np.ones(80, int)])
    assert rankers.qpfs(information.similarity_matrix(same)).shape == (5,)  # the label is never dropped
    df = spark.createDataFrame([(i, 1, f, int(bins[i, f])) for i in range(80) for f in (0, 3)], "id int, label int, f int, bin int")
    v = {r.f: r.v for r in information.relevance(df).collect()}
    assert np.isnan(v[3]) and v[0] == 0.0


def test_counts_in_chunks(monkeypatch):
    bins = np.random.default_rng(5).integers(0, 3, (50, 4))
    whole = information.joint_counts(bins, 3)
    monkeypatch.setattr(information, "CHUNK", 7)
    assert (information.joint_counts(bins, 3) == whole).all() and whole[1, 2].sum() == 50


def test_nominal_flags_by_group(spark):
    rows = [(p, i, [float(i % 2) if p == 0 else float(i), float(i) * 1.5, float(i % 3)]) for p in (0, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "p int, id int, features array<double>")
    assert {r.p: list(r.nominal) for r in prep.nominal_flags(df, 5, ("p",)).collect()} == {0: [True, False, True], 1: [False, False, True]}
    assert list(prep.nominal_flags(df, 5).first().nominal) == [False, False, True]


@pytest.mark.parametrize("method", ["smote", "nearmiss1", "nearmiss2"])
def test_nominal_features_in_the_ensemble(spark, method):
    rng = np.random.default_rng(6)
    rows = [(i, 0, float(i % 5 == 0), [float(rng.integers(0, 3)) / 2, float(rng.random()), float(rng.random())]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, p int, label double, features array<double>")
    made = ensemble.balanced(df, method, 1, 5, 5341, 5).collect()
    assert len(made) == (144 if method == "smote" else 48)
    assert {r.features[0] for r in made} <= {0.0, 0.5, 1.0}  # no value between two
    if method == "smote":
        assert any(r.features[0] not in (0.0, 0.5, 1.0) for r in ensemble.balanced(df, method, 1, 5, 5341).collect())


def test_gap_of_each_row(rows):
    made = balance.smote(rows, 2, "id", percentage=200, gap_per_row=True).collect()
    by_id = {r.id: r.features for r in rows.collect()}
    gaps = {round((f - a) / (b - a), 6) for r in made for f, a, b in zip(r.features, by_id[r.id], by_id[r.n_id]) if a != b}
    assert len(made) == 10 and len(gaps) > 5


def test_relieff_tells_nominal_by_group(spark):
    rng = np.random.default_rng(7)
    rows = [(p, i, str(i), float(i % 2), [float(i % 2) * (1 if p == 0 else 0.1) + (0 if p == 0 else float(rng.random()) / 100), float(rng.random())]) for p in (0, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "p int, id int, draw string, label double, features array<double>")
    w = {(r.p, r.f): r.w for r in rankers.relieff(df, 0, 3, keys=("p",), threshold=5).collect()}
    # nominal in group 0 only: differences of 1 there, of 0.1 elsewhere
    assert w[0, 0] == pytest.approx(40 * 3) and 8 < w[1, 0] < 14
    assert {(r.p, r.f): r.w for r in rankers.relieff(df, 0, 3, keys=("p",), threshold=5, blocks=3).collect()} == pytest.approx(w)


def test_quantile_bins_as_ntile(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f, float(rng.integers(0, 9)) if f else float(rng.random())) for f in (0, 1) for i in range(103)]
    df = spark.createDataFrame(rows, "id int, f int, v double")
    want = df.withColumn("bin", F.expr("cast(ntile(7) over (partition by f order by v, id) - 1 as int)"))
    assert sorted(map(tuple, prep.quantile_bins(df, "id", 7, ranges=5).collect())) == sorted(map(tuple, want.collect()))
    few = spark.createDataFrame(rows[:3], "id int, f int, v double")
    assert sorted(r.bin for r in prep.quantile_bins(few, "id", 5).collect()) == [0, 1, 2]


def test_prepare(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0, "x"), (2, 4.0, 5.0, "y"), (3, 3.0, 5.0, "x")], "k int, a double, b double, c string")
    got = {r.k: (list(r.features), r.label) for r in prep.prepare(df, ["a", "b"], "c", ("k",)).collect()}
    assert got == {1: ([0.0, 0.5], 0.0), 2: ([1.0, 0.5], 1.0), 3: ([0.5, 0.5], 0.0)}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 30])
def test_scores_in_the_jvm(spark, n):
    """Against the same in Python, with ranks at both ends, repeated and (but for owa) missing."""
    rng = np.random.default_rng(n)
    data = [[float(x) for x in rng.integers(1, 21, n) / 20] for _ in range(20)] + [[1.0] * n, [0.001] * n]
    holed = [[float("nan")] * (n - 1) + [0.3], *data]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(holed)], "i int, r array<double>")
    want = {"mean": lambda x: fusing.normal_cdf(float(np.nanmean(x)), 0.5, (1 / 12 / np.count_nonzero(~np.isnan(x))) ** 0.5), "RRA": fusing.rra, "stuart": fusing.stuart}
    for m, f in want.items():
        if m == "stuart" and n > 7:
            continue
        got = {r.i: r.s for r in df.select("i", fusion.score(m).alias("s")).collect()}
        assert [got[i] for i in range(len(holed))] == pytest.approx([f(np.array(x)) for x in holed], rel=1e-7, abs=1e-12), m
    for risk in (0.0, 0.05, 0.5, 0.75, 1.0):
        got = {r.i: r.s for r in df.filter("i > 0").select("i", fusion.score("owa", risk).alias("s")).collect()}
        assert [got[i + 1] for i in range(len(data))] == pytest.approx([fusing.owa(np.array(x), fusing.owa_weights(n, risk)) for x in data]), risk


def test_sweep_agrees_with_single_settings(spark):
    rng = np.random.default_rng(9)
    w = spark.createDataFrame([(p, b, f, float(rng.random())) for p in range(3) for b in range(2) for f in range(6)], "p int, bag int, f int, w double").persist()
    got = {}
    for r in fusion.sweep(w).collect():
        got.setdefault(r.setting, {})[r.item] = r.pos
    assert len(got) == 31
    for name, (m, a, b) in {"RRA": ("RRA", 0.5, 0.5), "geom.mean": ("geom.mean", 0.5, 0.5), "owa 0.95 0.25": ("owa", 0.95, 0.25)}.items():
        assert got[name] == {r.item: r.pos for r in fusion.two_level(w, m, m, a, b).collect()}


def test_binary_files_are_split(spark, tmp_path):
    data = np.random.default_rng(10).integers(-128, 128, (1000, 4)).astype(np.int8)
    (tmp_path / "x.bin").write_bytes(data.tobytes())
    got = io.read_binary(spark, str(tmp_path / "x.bin"), Dataset("x", 3, binary=True), split=800)
    assert got.rdd.getNumPartitions() >= 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, data.tolist()))


def test_save_output(spark, tmp_path):
    for append, want in ((False, b"a\n"), (True, b"a\na\n"), (False, b"a\n")):
        io.save_output(spark, str(tmp_path / "out.txt"), b"a\n", append)
        assert (tmp_path / "out.txt").read_bytes() == want


def test_fusion_ties_and_identity(spark):
    two = [(0, str(i), i) for i in range(12)] + [(1, str(i), 11 - i) for i in range(12)]
    got = fusion.fuse(spark.createDataFrame(two, "list_id int, item string, pos int"), "min").orderBy("pos").collect()
    assert [r.item for r in got] == "0 11 1 10 2 9 3 8 4 7 5 6".split()
    same = spark.createDataFrame([(k, x, i) for k in range(3) for i, x in enumerate("dcba")], "list_id int, item string, pos int")
    for m in fusion.METHODS:
        # RRA cuts its scores at 1, so its last two tie
        assert "".join(r.item for r in fusion.fuse(same, m).orderBy("pos").collect()) == ("dcab" if m == "RRA" else "dcba")
    with pytest.raises(ValueError):
        fusion.fuse(same, "sum")


def _java_doubles(seed, n):
    mask = (1 << 48) - 1
    s = (seed ^ 0x5DEECE66D) & mask

    def bits(k):
        nonlocal s
        s = (s * 0x5DEECE66D + 0xB) & mask
        return s >> (48 - k)

    return [((bits(26) << 27) + bits(27)) / (1 << 53) for _ in range(n)]


def test_two_levels(spark):
    values = _java_doubles(4356, 1000)
    cube = spark.createDataFrame([(i // 100, i // 10 % 10, i % 10, v) for i, v in enumerate(values)], "p int, bag int, f int, w double").persist()
    for first, second, r1, r2, want in (
        ("owa", "owa", 0.95, 0.95, "4380126759"), ("owa", "owa", 0.95, 0.05, "5027481936"), ("owa", "owa", 0.05, 0.95, "3097482165"), ("min", "min", 0.5, 0.5, "0123456789"),
        ("median", "median", 0.5, 0.5, "4315602978"), ("geom.mean", "geom.mean", 0.5, 0.5, "4031586279"), ("RRA", "RRA", 0.5, 0.5, "0123456789"), ("stuart", "stuart", 0.5, 0.5, "0541368927"),
    ):
        assert "".join(r.item for r in fusion.two_level(cube, first, second, r1, r2).orderBy("pos").collect()) == want, (first, r1, r2)


@pytest.mark.parametrize(("method", "balancing"), [("QPFS", "BaggingUnderSampling"), ("SRFS", "NearMiss1"), ("TPFS", "none"), ("ReliefF", "SMOTE")])
def test_ensemble_finds_the_telling_feature(spark, method, balancing):
    rng = np.random.default_rng(5)
    data = []
    for i in range(240):
        y = int(i % 6 == 0)
        x = rng.random(5)
        x[3] = 0.9 * y + 0.1 * x[3]
        data.append((i, float(y), x.tolist()))
    df = spark.createDataFrame(data, "id long, label double, features array<double>")
    model = EnsembleRanker(rankingMethod=method, balancingMethod=balancing, numPartition=2, bagNum=2, firstFusionMethod="mean", secondFusionMethod="mean", selectionThreshold=0.2).fit(df)
    assert model.selected() == [3]
    assert model.transform(df).first().selected == [data[0][2][3]]


def test_settings_are_checked():
    for bad in ({"maxBin": 0}, {"rankingMethod": "x"}, {"numPartition": 0}, {"firstRiskFusion": 0.0}, {"balancingMethod": ""}):
        with pytest.raises(ValueError):
            EnsembleRanker(**bad)
    own = EnsembleRanker(firstFusionMethod="owa")
    assert (own.of("firstFusionMethod"), own.of("secondFusionMethod")) == ("owa", "min")


def test_files(spark, tmp_path):
    data = Dataset("t", 2, binary=True)
    (tmp_path / "b").write_bytes(bytes([1, 255, 0, 128, 127, 1]))
    assert sorted(map(tuple, io.read(spark, str(tmp_path / "b"), data).collect())) == [(-128, 127, 1), (1, -1, 0)]
    (tmp_path / "c.csv").write_text('1,"2",0\n3,4,1\n')
    got = io.read(spark, str(tmp_path / "c.csv"), Dataset("t", 2), 3)
    assert sorted((r.col0, r.label) for r in got.collect()) == [(1.0, 0.0), (3.0, 1.0)] and got.rdd.getNumPartitions() == 3
    io.write_ranks(spark.createDataFrame([("a", [2, 0, 1])], "name string, ranking array<int>"), str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["2,0,1"]
    io.log_time(spark, str(tmp_path / "log"), "x", 3, 1.5)
    assert spark.read.csv(str(tmp_path / "log")).count() == 1
    assert by_file_name("/d/Wiretap_train.csv").features == 115 and len(DATASETS) == 16
    assert io.balanced_partitions(20, 4, 4) == 16 and io.balanced_partitions(1, 4, 4) == 1 and io.balanced_partitions(7, 4, 4, local=True) == 7
    q = prep.quantile_discretiser(["x"], 3).fit(spark.createDataFrame([(float(i),) for i in range(30)], "x double"))
    io.save_discretiser(q, str(tmp_path), "q")
    assert io.load_discretiser(str(tmp_path), "q").getSplitsArray() == q.getSplitsArray()


def test_assemble_and_index(spark):
    df = spark.createDataFrame([(1.0, 2, "b"), (3.0, 4, "a"), (5.0, 6, "b")], "x double, y int, l string")
    got = prep.index_labels(prep.assemble(df, ["x", "y"], "l")).collect()
    assert sorted((r.features, r.label) for r in got) == [([1.0, 2.0], 0.0), ([3.0, 4.0], 1.0), ([5.0, 6.0], 0.0)]
    with pytest.raises(Exception, match="null feature"):
        prep.assemble(spark.createDataFrame([(None, "a")], "x double, l string"), ["x"], "l").collect()


def test_relieff_on_constant_and_small_groups(spark):
    df = spark.createDataFrame([(i, i, float(i % 2), [0.5, i / 9]) for i in range(10)], "id long, draw long, label double, features array<double>")
    w = {r.f: r.w for r in rankers.relieff(df, 0, 3).collect()}
    assert w[0] == 0.0


def test_running_minmax(spark, tmp_path):
    from rankforge.streaming import running_minmax

    spark.createDataFrame([([1.0, 5.0],), ([3.0, 2.0],)], "features array<double>").write.parquet(str(tmp_path / "s"))
    q = running_minmax(spark.readStream.schema("features array<double>").parquet(str(tmp_path / "s"))).writeStream.outputMode("complete").format("memory").queryName("mm").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("mm").collect())) == [(0, 1.0, 3.0), (1, 2.0, 5.0)]
