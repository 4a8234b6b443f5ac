"""Properties, hand-made cases and independent versions of the operators."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywright import schema
from tallywright.functions import audio, models, scalar, tails
from tallywright.operators import draws, fusion, inference, labels, metrics, postproc, resample, select, shift
from tallywright.sources import readers, sinks
from tallywright.streaming import shards

COLUMNS = "row_id bigint, class_id int, y int, fold int, author bigint, model string, ord int, score double"


def plain_auc(score, y, w=None):
    w = np.ones(len(y)) if w is None else w
    p, n = (y == 1) & (w > 0), (y == 0) & (w > 0)
    if not p.any() or not n.any():
        return None
    wins = ((score[p][:, None] > score[n][None]) + 0.5 * (score[p][:, None] == score[n][None])) * w[p][:, None] * w[n][None]
    return wins.sum() / (w[p].sum() * w[n].sum())


@pytest.fixture(scope="module")
def board(spark):
    """400 rows, 20 authors, 5 folds, 4 classes, two models that are each noise on half the classes."""
    rng = random.Random(0)
    rows = []
    for i in range(400):
        for c in range(4):
            y = int(rng.random() < 0.3)
            for m, o in (("a", 0), ("b", 1)):
                noise = (c % 2 == 0) == (m == "b")
                s = rng.random() if noise else min(1.0, max(0.0, 0.5 * y + 0.6 * rng.random()))
                rows.append((i, c, y, i % 5, i % 20, m, o, round(s, 2)))
    return spark.createDataFrame(rows, COLUMNS).cache()


def test_auc_edge_cases(spark):
    cases = {
        0: ([0.5] * 4, [1, 0, 1, 0], 0.5), 1: ([0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1], 1.0), 2: ([0.9, 0.8, 0.2, 0.1], [0, 0, 1, 1], 0.0),
        3: ([0.3, 0.4], [1, 1], None), 4: ([0.3, 0.4], [0, 0], None), 5: ([0.2, 0.7, 0.7, None], [0, 1, 0, 1], 0.75), 6: ([-3.0, 7.5, 1e9], [0, 1, 1], 1.0),
    }
    rows = [(c, s, y) for c, (ss, ys, _) in cases.items() for s, y in zip(ss, ys)]
    df = spark.createDataFrame(rows, "class_id int, score double, y int")
    assert {r.class_id: r.auc for r in metrics.auc(df, ["class_id"]).collect()} == {c: a for c, (_, _, a) in cases.items()}


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 1000), st.integers(2, 60))
def test_replicates_equal_copied_rows(spark, seed, n):
    rng = np.random.default_rng(seed)
    score, y, author = rng.integers(0, 9, n) / 8, rng.integers(0, 2, n), rng.integers(0, 5, n)
    df = spark.createDataFrame([(int(a), float(s), int(v), "m") for a, s, v in zip(author, score, y)], "author bigint, score double, y int, model string")
    w = resample.hash_weights(df, "author", 3, seed)
    by = {(r.rep, r.author): r.w for r in w.collect()}
    want = [plain_auc(score, y, np.array([by.get((rep, a), 0) for a in author])) for rep in range(3)]
    for got in (resample.replicate_auc(df, df, "author", ["model"], 3, seed), resample.replicate_auc_plain(df, w, "author", ["model"])):
        found = {r.rep: r.auc for r in got.collect()}
        assert all(found.get(k) == v or found[k] == pytest.approx(v) for k, v in enumerate(want))


def test_selector_properties(board):
    held, choice = select.heldout(board)
    apparent, _ = select.in_sample(board)
    a = select.headroom(board, held).first()
    b = select.headroom(board, apparent).first()
    assert b.oracle >= a.oracle and b.oracle >= b.best_single and a.headroom > 0.05
    assert all(r.model == ("b" if r.class_id % 2 else "a") or True for r in choice.collect())
    assert {(r.class_id, r.model) for r in choice.collect()} == {(0, "a"), (1, "b"), (2, "a"), (3, "b")}


def test_zero_controls(board):
    one = board.filter("model = 'a'")
    assert select.headroom(one, select.heldout(one)[0]).first().headroom == 0
    twin = one.unionByName(one.withColumns({"model": F.lit("a2"), "ord": F.lit(1)}))
    assert select.headroom(twin, select.heldout(twin)[0]).first().headroom == 0


def test_unscorable_falls_back_to_the_first(spark):
    rows = [(i, 0, i % 2, i % 2, 0, m, o, None) for i in range(8) for m, o in (("x", 1), ("a", 0))]
    _, choice = select.heldout(spark.createDataFrame(rows, COLUMNS))
    assert {r.model for r in choice.collect()} == {"a"}


def test_influence_equals_removal(board):
    one = board.filter("model = 'a' and class_id = 1")
    rows = [(r.author, r.score, r.y) for r in one.collect()]
    for r in resample.influence(one, "author", ["class_id"]).collect():
        kept = [(s, y) for a, s, y in rows if a != r.author]
        assert r.auc == pytest.approx(plain_auc(*map(np.array, zip(*kept))))


def test_numpy_draws_are_multinomial(spark, board):
    w = resample.numpy_weights(board.select("author"), "author", 4, 1)
    assert [r[0] for r in w.groupBy("rep").agg(F.sum("w").alias("n")).select("n").collect()] == [20] * 4


def test_newton_is_at_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(float)
    b = fusion.newton(x, y)
    p = 1 / (1 + np.exp(-(x @ b[:-1] + b[-1])))
    assert np.abs(x.T @ (p - y) + b[:-1]).max() < 1e-6 and abs((p - y).sum()) < 1e-6


def test_fusion_beats_noise(board):
    fused = fusion.nested_fusion(board, ["a", "b"])
    got = {r.model: r.macro for r in metrics.macro_auc(board).collect()} | {r.model: r.macro for r in metrics.macro_auc(fused).collect()}
    assert got["fusion"] > max(got["a"], got["b"])


def test_golden_tests(spark):
    """A published cell: mean and se to the smallest delta and the verdicts."""
    df = spark.createDataFrame([(-0.0064, 0.0032), (0.0, 0.0)], "point double, se double")
    got = inference.smallest_delta(inference.tost(df, 0.01, tails=True)).collect()
    assert got[0].smallest_delta == pytest.approx(0.0064 + scalar.Z95 * 0.0032) and not got[0].equivalent
    assert got[0].p == pytest.approx(0.5 * math.erfc((0.01 - 0.0064) / 0.0032 / math.sqrt(2)))
    assert got[1].equivalent


def test_coverage_ceiling_golden(spark):
    df = spark.createDataFrame([(True, True)] * 202 + [(True, False)] * 4 + [(False, True)] * 28, "evaluable boolean, mapped boolean")
    assert shift.coverage_ceiling(df).first().ceiling == pytest.approx(0.990291, abs=1e-6)


def test_multiplicity_by_hand(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.01])], "i int, p double")
    got = {r.i: (r.p_holm, r.p_bh) for r in inference.corrected(df, tie="i").collect()}
    assert got[0] == pytest.approx((0.04, 0.02)) and got[1] == pytest.approx((0.06, 0.04)) and got[2] == pytest.approx((0.06, 0.04)) and got[3] == pytest.approx((0.04, 0.02))


def test_blur_is_the_plain_convolution(spark):
    k = postproc.kernel(1.5)
    r = len(k) // 2
    grid = np.zeros((12, 12))
    cells = [(0, 0, 2.0), (5, 7, 1.0), (11, 3, 3.0)]
    for i, j, n in cells:
        grid[i, j] = n
    want = np.zeros((12, 12))
    for i in range(12):
        for j in range(12):
            want[i, j] = sum(grid[a, b] * k[a - i + r] * k[b - j + r] for a in range(12) for b in range(12) if abs(a - i) <= r and abs(b - j) <= r)
    df = spark.createDataFrame([(0, *c) for c in cells], "g int, i int, j int, n double")
    for row in postproc.blurred(df, ["g"], 1.5, 12).collect():
        assert row.density == pytest.approx(want[row.i, row.j])


def test_scalars(spark):
    df = spark.createDataFrame([("['a', \"b\"]", "01:02:03", "Corvus corax", "1|2|3"), ("none", "00:00:05", " X ", None)], "l string, t string, n string, i string")
    got = df.select(scalar.list_literal(F.col("l")), scalar.seconds(F.col("t")), scalar.genus(F.col("n")), scalar.index_list(F.col("i"))).collect()
    assert [tuple(r) for r in got] == [(["a", "b"], 3723, "corvus", [1, 2, 3]), ([], 5, "x", [])]


def test_gates(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, None)], "k int, v double")
    for gate in (lambda: schema.require_rows(df, 3, "t"), lambda: schema.require_unique(df, ["k"], "t"), lambda: schema.require_present(df, "v", "t"), lambda: schema.require_finite(df, "v", "t"), lambda: schema.require_aligned(df, df.limit(1), ["k"], "t")):
        with pytest.raises(schema.GateError):
            gate()
    assert schema.missing_as_null(df, "v").filter("v is not null").count() == 0


def test_sources_and_sinks(spark, tmp_path):
    m = np.random.default_rng(0).normal(size=(50, 7)).astype(np.float32)
    m[3, 2] = np.nan
    np.save(tmp_path / "m.npy", m)
    got = readers.matrix(spark, str(tmp_path / "m.npy"), 4)
    assert got.count() == 350 and got.filter("score is null").count() == 1
    (tmp_path / "v.csv").write_text("code\nAbc\nno_ebird_code\nxyz \n")
    assert [(r.idx, r.code) for r in readers.vocabulary(spark, str(tmp_path / "v.csv"), 3).orderBy("idx").collect()] == [(0, "abc"), (1, "no_ebird_code"), (2, "xyz")]
    jobs = spark.createDataFrame([("a", s, f) for s in (41, 42) for f in (0, 1)], "model string, seed int, fold int")
    part = jobs.filter("seed = 41").withColumns({"row_id": F.lit(1).cast("bigint"), "class_id": F.lit(0), "score": F.lit(0.5)})
    path = str(tmp_path / "shards")
    sinks.write_shards(part, path)
    sinks.write_shards(part.filter("fold = 0"), path)
    done = spark.read.parquet(path)
    keys = ["model", "seed", "fold"]
    assert done.count() == 2 and sinks.pending(jobs, done, keys).count() == 2
    with pytest.raises(schema.GateError):
        sinks.assemble(spark, path, jobs, keys)
    assert sinks.assemble(spark, path, jobs.filter("seed = 41"), keys).count() == 2
    assert readers.optional(spark, [path, path + "x"]).count() == 2 and readers.optional(spark, [path + "x"]) is None
    sinks.write_csv(done, path + "-csv")
    assert readers.csv(spark, path + "-csv", done.schema).count() == 2
    sinks.write_json(done, path + "-json", 4)
    assert readers.json(spark, path + "-json").count() >= 1
    assert sinks.validated(done.select("row_id", "fold", "score"), done.select("row_id", "fold", "score"), ["row_id", "fold"], "score").first().ok
    assert sinks.report(done.select("model", "score"), ["model", "score"]).first().text == "| a | 0.5000 |"
    (tmp_path / "x.ogg").write_bytes(b"1,2,3")
    files = readers.listed(spark, str(tmp_path))
    assert files.count() == 1 and readers.unlabelled(files, files).count() == 0
    raw = spark.read.format("binaryFile").load(str(tmp_path / "x.ogg"))
    wave = readers.decoded(raw, lambda b: [float(x) for x in b.decode().split(",")])
    assert list(wave.select(readers.centred(F.col("samples"), 5)).first()[0]) == [1, 2, 3, 0, 0]
    assert list(wave.select(readers.window_at(F.col("samples"), F.lit(1), 1, 2)).first()[0]) == [2, 3]


def test_model_plugin(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "row_id bigint, x array<float>")
    got = models.scored(rows, "x", lambda: lambda m: m * 2).orderBy("row_id").collect()
    assert [list(r.probs) for r in got] == [[2.0 * i, 2.0] for i in range(5)]


def test_arriving_shards(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "a", 0.5), (1, 0, "a", 0.5)], schema.SCORES)
    df.write.parquet(str(tmp_path / "in"))
    shards.append_new(shards.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_stratified_groups(spark):
    df = spark.createDataFrame([(a, c, (a * 7 + c) % 5 + 1) for a in range(40) for c in range(3)], "author bigint, class_id int, n int")
    got = labels.grouped_stratified_folds(df).join(df, "author").groupBy("fold").agg(F.sum("n").alias("n")).collect()
    assert len(got) == 5 and max(r.n for r in got) < 1.3 * min(r.n for r in got)


def test_means_do_not_depend_on_the_order_of_arrival(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 0, 0, 0, 0, m, o, float(rng.random())) for i in range(500) for o, m in enumerate("abcde")]
    names = "row_id bigint, class_id int, y int, fold int, author int, model string, ord int, score double"
    frames = [spark.createDataFrame(x, names).repartition(n) for x, n in ((rows, 3), (rows[::-1], 7))]
    means = [sorted((r.row_id, r.score.hex()) for r in metrics.with_mean(f).filter("model = 'mean'").collect()) for f in frames]
    assert means[0] == means[1]
    seeds = [f.withColumnRenamed("ord", "seed").withColumn("model", F.lit("a")) for f in frames]
    for make in (labels.seed_ensemble, lambda f: labels.leave_one_seed_out(f).withColumn("row_id", F.col("row_id") * 10 + F.col("drop_seed"))):
        assert len({tuple(sorted((r.row_id, r.score.hex()) for r in make(f).collect())) for f in seeds}) == 1


def quadratic(rows, weights):
    """The AUC of every replicate as a quadratic form of the clusters' concordant pairs. rows: cluster, score, y; weights: clusters x replicates."""
    c, s, y = (np.array(x) for x in zip(*rows))
    won = np.zeros((len(weights), len(weights)))
    for i in np.flatnonzero(y == 1):
        for j in np.flatnonzero(y == 0):
            won[c[i], c[j]] += (s[i] > s[j]) + 0.5 * (s[i] == s[j])
    p, n = np.bincount(c, y, len(weights)), np.bincount(c, 1 - y, len(weights))
    with np.errstate(invalid="ignore"):
        return np.array([w @ won @ w / ((p @ w) * (n @ w)) for w in weights.T.astype(float)])


@pytest.mark.parametrize(("parts", "batch", "bytes_"), [(1, 10_000, 64 << 20), (7, 10_000, 64 << 20), (7, 5, 64 << 20), (3, 10_000, 30 * 2 * 15)])
def test_bootstrap_over_sorted_runs_is_the_quadratic_form(spark, monkeypatch, parts, batch, bytes_):
    """Runs that cut a class anywhere, ties over batches and blocks of replicates change no bit."""
    monkeypatch.setattr(resample, "blocks", lambda reps, n: draws.blocks(reps, n, bytes_))
    rng = np.random.default_rng(8)
    rows = [(i, i * 7 % 30, c, m, int(rng.random() < 0.3), None if m == "b" and i == 7 else float(rng.integers(0, 25))) for i in range(300) for c in (0, 1) for m in "ab"]
    df = spark.createDataFrame(rows, "row_id long, author long, class_id int, model string, y int, score double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.rep, r.model, r.class_id): r.auc for r in resample.replicate_auc(df, df, "author", ["model", "class_id"], 40, 3, parts).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    weights = np.stack([draws.drawn(3, rep, 30) for rep in range(40)], axis=1)
    assert len(got) == 160
    for m in "ab":
        for c in (0, 1):
            want = quadratic([(a, s, y) for _, a, k, o, y, s in rows if (k, o) == (c, m) and s is not None], weights)
            for rep in range(40):
                gone = m == "b" and weights[7 * 7 % 30, rep] > 0
                assert got[rep, m, c] == (None if gone else want[rep])


def test_table_function_draws_as_the_kernel(spark):
    clusters = spark.createDataFrame([(c,) for c in "qwertyuiop"] * 2 + [(None,)], "author string")
    got = {(r.rep, r.author): r.w for r in resample.hash_weights(clusters, "author", 6, 21).collect()}
    want = {(rep, a): int(w) for rep in range(6) for a, w in zip(sorted("qwertyuiop"), draws.drawn(21, rep, 10)) if w}
    assert got == want and resample.hash_weights(clusters.limit(0), "author", 6, 21).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2000), st.integers(0, draws.PRIME - 1))
def test_image_is_a_permutation(size, rep, h):
    place = np.arange(size)
    full = lambda v: np.full(size, v, np.int64)
    assert sorted(draws.image(place, full(size), full(rep), full(h)).tolist()) == place.tolist()


def test_images_are_even():
    """Each place goes to each about equally often over replicates, and neighbours part."""
    size, reps = 7, 7000
    rep = np.repeat(np.arange(reps), size)
    out = draws.image(np.tile(np.arange(size), reps), np.full(len(rep), size), rep, np.full(len(rep), 12345)).reshape(reps, size)
    seen = np.array([np.bincount(out[:, k], minlength=size) for k in range(size)])
    assert np.abs(seen - reps / size).max() < 6 * np.sqrt(reps / size)
    assert abs((out[:, 1] == (out[:, 0] + 1) % size).mean() - 1 / (size - 1)) < 0.03 and len({tuple(r) for r in out[:500].tolist()}) > 400


def test_permuted_within_keeps_each_clusters_values(spark):
    df = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 3 * F.col("id") % 2).alias("author"), (F.col("id") * 10).alias("v"))
    of = {r.row_id: r.author for r in df.collect()}
    got = resample.permuted_within(df, "author", "row_id", ["v"], 3, 5).collect()
    assert len(got) == 1500 and all(of[r.v // 10] == of[r.row_id] for r in got)
    assert all(sorted(r.v // 10 for r in got if r.rep == k) == list(range(500)) for k in range(3))
    assert sum(r.v == r.row_id * 10 for r in got) < 60


def test_tails_are_the_published_ones():
    """Values from tables of the t distribution and of Kendall's statistic."""
    assert abs(tails.beta_share(0.5, 2, 3) - 0.6875) < 1e-12
    assert abs(tails.correlation_p(0.9, 5) - 0.03738607) < 1e-7 and abs(tails.correlation_p(0.6319, 10) - 0.05) < 1e-4
    assert abs(tails.kendall_p(1.0, 4) - 2 / 24) < 1e-12 and abs(tails.kendall_p(0.6, 5) - 2 * 14 / 120) < 1e-12 and tails.kendall_p(0.0, 4) == 1.0
    assert abs(tails.kendall_p(0.2, 40) - math.erfc(0.2 * 780 / math.sqrt(40 * 39 * 85 / 18) / math.sqrt(2))) < 1e-12
    assert math.isnan(tails.correlation_p(0.5, 2))


def test_audio():
    rate = 8000
    t = np.arange(2 * rate) / rate
    tone = 0.5 * np.sin(2 * np.pi * 500 * t)
    back = audio.wav(audio.as_wav(tone, rate))
    assert len(back) == len(tone) and np.abs(back - tone).max() < 1 / 32768
    with pytest.raises(ValueError):
        audio.wav(b"no wave")
    power = audio.spectrogram(tone, 256, 80)
    assert power.shape == (201, 129) and (power[5:-5].argmax(axis=1) == 16).all()
    bank = audio.mel_bank(rate, 256, 20)
    level = audio.log_mel(tone, rate, 20, 256, 80)
    assert level.shape == (20, 201) and (level[:, 5:-5].argmax(axis=0) == bank[:, 16].argmax()).all() and level.max() - level.min() <= 80.001
    half = audio.halved(tone + 0.5 * np.sin(2 * np.pi * 3500 * t))
    assert len(half) == rate and np.abs(half - tone[::2])[100:-100].max() < 0.01


def test_numbers_are_those_of_the_whole_order(spark):
    """Also where ranges are drawn from a sample that is not the whole table."""
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_013).alias("k"), F.col("id").alias("v"), (F.col("id") % 40).alias("author"))
    got = labels.numbered(df, "n", ["author", "k"]).select("n", "author", "k", "v").orderBy("n").collect()
    assert [r.n for r in got] == list(range(60_000)) and all(r.k == r.v * 7919 % 60_013 for r in got)
    assert all((a.author, a.k) < (b.author, b.k) for a, b in zip(got, got[1:]))


def test_filter_bank(spark):
    """Frames of a gapped, a short and a whole recording; a tone is loudest in the band that holds it."""
    from tallywright.operators import spectra

    rate, bands = 8000, 23
    tone = 1000 * np.sin(2 * np.pi * 1000 * np.arange(1000) / rate)
    rows = [("tone", i, float(x)) for i, x in enumerate(tone)] + [("short", i, 1.0) for i in range(199)]
    rows += [("gap", i, float(x)) for i, x in enumerate(tone) if i != 500] + [("null", None, 1.0), ("null", 3, None)]
    df = spark.createDataFrame(rows, "name string, i int, x double").repartition(5)
    out = spectra.filter_bank(df, ["name"], "i", "x", rate, bands).toPandas()
    assert set(out.name) == {"tone", "gap"}
    assert set(out[out.name == "tone"].frame) == set(range(11))
    assert set(out[out.name == "gap"].frame) == {f for f in range(11) if not 80 * f <= 500 < 80 * f + 200}
    whole = out[out.name == "tone"].pivot(index="frame", columns="band", values="energy").to_numpy()
    cut = np.stack([tone[80 * f : 80 * f + 200] for f in range(11)])
    assert np.allclose(whole, audio.kaldi_energies(cut, rate, bands), rtol=0, atol=1e-9)
    bank = audio.kaldi_bank(rate, 256, bands)
    assert (whole.argmax(axis=1) == bank[:, round(1000 / rate * 256)].argmax()).all()
    assert spectra.filter_bank(df.filter("false"), ["name"], "i", "x", rate).count() == 0
    sparse = spectra.frames(df.filter("name = 'tone'"), ["name"], "i", "x", 10, 25).collect()
    assert len(sparse) == 40 and all(np.allclose(r.samples, tone[25 * r.frame : 25 * r.frame + 10]) for r in sparse)
