import numpy as np

from veristrata.llm import neighbours as N

SCHEMA = "text_id string, backend string, model string, revision string, dimension int, vector array<float>, grp string, rep string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def brute(vectors, k=5):
    """vectors: (model, revision) -> {text_id: vector}."""
    out = {}
    for key, own in vectors.items():
        ids = sorted(own)
        x = np.array([own[i] for i in ids], dtype=np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        sim = np.round(x @ x.T, 6)
        for i, t in enumerate(ids):
            order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-sim[i, j], ids[j]))[:k]
            out[(*key, t)] = [ids[j] for j in order]
    return out


def test_small_groups_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(8)
    good = {f"t{i:02d}": (base * (1 + i % 3) if i < 9 else rng.standard_normal(8)).astype(np.float32).tolist() for i in range(30)}
    rows = [(t, "local", "m", "r", 8, v) for t, v in good.items()] + [(t, "remote", "m", "r", 8, v) for t, v in list(good.items())[:5]]
    rows += [("bad1", "b", "m", "r", 8, None), ("bad2", "b", "m", "r", 8, [1.0] * 7), ("bad3", "b", "m", "r", None, [1.0] * 8), ("bad4", "b", "m", "r", 8, [0.0] * 8), ("bad5", "b", "m", "r", 8, [float("nan")] + [1.0] * 7), ("bad6", "b", "m", "r", 8, [None] + [1.0] * 7), (None, "b", "m", "r", 8, [1.0] * 8)]
    rows += [("t00", "b", "m2", None, 2, [1.0, 0.0]), ("lone", "b", "m3", "r", 2, [1.0, 0.0])]
    found = {}
    for r in N.nearest_texts(table(spark, rows)).orderBy("rank").collect():
        found.setdefault((r.model, r.revision, r.text_id), []).append(r.neighbour)
    assert found == brute({("m", "r"): good})


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 16))
    vectors = {f"v{i:05d}": (centres[i % 60] + 0.35 * rng.standard_normal(16)).astype(np.float32).tolist() for i in range(3000)}
    for i in range(900):  # a third of all rows are one vector
        vectors[f"w{i:05d}"] = vectors["v00000"]
    rows = [(t, "b", "m", "r", 16, v) for t, v in vectors.items()]
    want = brute({("m", "r"): vectors})
    got = {}
    for r in N.nearest_texts(table(spark, rows)).collect():
        got.setdefault((r.model, r.revision, r.text_id), set()).add(r.neighbour)
    hit = sum(len(got[k] & set(v)) for k, v in want.items())
    assert hit / sum(len(v) for v in want.values()) >= 0.95
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())


def test_adaptive_scan_keeps_what_is_near():
    rng = np.random.default_rng(0)
    turn = N.rotation(64)
    x = rng.standard_normal((2000, 64)) / 8
    q = x[:50] + 0.02 * rng.standard_normal((50, 64))
    q, x = (q @ turn).astype(np.float32), (x @ turn).astype(np.float32)
    limit = np.full(50, 0.9, dtype=np.float32)
    i, j = N.adaptive_scan(q, x, limit)
    true = ((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) <= 0.9
    kept = np.zeros_like(true)
    kept[i, j] = True
    assert (kept & true).sum() >= 0.99 * true.sum() and not (kept & ~true).sum() > 0.01 * kept.sum()


def test_empty_table(spark):
    assert N.nearest_texts(table(spark, [])).count() == 0
    assert N.similar_pairs(table(spark, [("x", "b", "m", "r", 1, None)])).count() == 0


def test_exact_search_misses_nothing(spark):
    rng = np.random.default_rng(9)
    vectors = {f"v{i:04d}": rng.standard_normal(24).astype(np.float32).tolist() for i in range(900)}  # no clusters at all
    rows = [(t, "b", "m", "r", 24, v) for t, v in vectors.items()]
    got = {}
    for r in N.nearest_texts(table(spark, rows), exact=True, list_size=20).orderBy("rank").collect():
        got.setdefault(("m", "r", r.text_id), []).append(r.neighbour)
    assert got == brute({("m", "r"): vectors})


def test_probes_grow_with_the_lists():
    assert N.probes_for(1) == N.probes_for(256) == N.PROBES and N.probes_for(1024) == 2 * N.PROBES and N.probes_for(4096) == 4 * N.PROBES


def shuffled(spark):
    """Bytes that shuffles have written so far."""
    each = spark._jsc.sc().statusStore().executorList(False)
    return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))


def test_vectors_are_not_copied_for_the_lists_they_probe(spark):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((150, 64))
    vectors = {f"v{i:05d}": (centres[i % 150] + rng.standard_normal(64)).astype(np.float32).tolist() for i in range(4000)}
    df = table(spark, [(t, "b", "m", "r", 64, v) for t, v in vectors.items()]).cache()
    df.count()
    before = shuffled(spark)
    assert N.nearest_texts(df, list_size=25).count() == 20_000
    assert shuffled(spark) - before < 10 * 4000 * 64 * 4
    df.unpersist()


def test_units_and_blocks_leave_nothing_behind(spark, monkeypatch):
    monkeypatch.setattr(N, "UNIT_ROWS", 64)
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    kept = []
    monkeypatch.setattr(N, "store", lambda classes, index, folder, of=N.store: (of(classes, index, folder), kept.append((index, folder))))
    rng = np.random.default_rng(12)
    vectors = {f"v{i:04d}": rng.standard_normal(12).astype(np.float32).tolist() for i in range(700)}
    vectors |= {f"w{i:04d}": vectors[f"v{i % 5:04d}"] for i in range(30)} | {f"x{i:04d}": vectors[f"v{i + 20:04d}"] for i in range(3)}
    got = {}
    for r in N.nearest_texts(table(spark, [(t, "b", "m", "r", 12, v) for t, v in vectors.items()]), k=9, exact=True, list_size=100).orderBy("rank").collect():
        got.setdefault(("m", "r", r.text_id), []).append(r.neighbour)
    assert got == brute({("m", "r"): vectors}, k=9)
    (index, folder), = kept
    assert max(len(x) for x in index.parts.values()) > 2 and len({f for x in index.parts.values() for f, _ in x}) > 8
    assert not spark._jvm.java.io.File(folder.removeprefix("file:")).exists()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == spark.newSession().conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
