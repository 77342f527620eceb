import numpy as np

from castmill.llm import copies, pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edited(rng, words, n):
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"new{rng.integers(10**9)}"
    return out


def wide_set(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def over(a, b):
    return len(wide_set(a) & wide_set(b)) / len(wide_set(a) | wide_set(b))


def test_stage_drops_near_copies(spark):
    """Copies of five-word Jaccard 0.8 to 0.95 are further apart than two fingerprint bits, and yet go."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        other = edited(rng, base, 1 + k % 6)
        rows += [(2 * k, base), (2 * k + 1, other if over(base, other) >= 0.8 else edited(rng, base, 150))]
    docs = spark.createDataFrame([(i, " ".join(w), "en", None, 1) for i, w in rows], SCHEMA)
    kept = {r["doc_id"] for r in pipeline.keep_one_of_group(spark, docs, "").collect()}
    want = {i for i, w in rows if i % 2 == 0 or over(rows[i - 1][1], w) < 0.8}
    assert kept == want and len(want) < 90


def test_components_against_brute_force(spark):
    """Copies of one text, of which few pairs reach the threshold by themselves."""
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
    rows = [base, *(edited(rng, base, int(rng.integers(1, 10))) for _ in range(60)), ["a"], ["A"], []]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    root = list(range(len(rows)))
    near = [(i, j) for i in range(61) for j in range(i) if over(rows[i], rows[j]) >= 0.8]
    for _ in rows:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    root[62] = 61
    assert {r["doc_id"]: r["component_id"] for r in copies.near_copies(docs).collect()} == dict(enumerate(root))


def test_recall_at_the_threshold():
    """Of pairs at Jaccard 0.8, at least 99 in 100 share a bucket."""
    rng = np.random.default_rng(5)
    hit = 0
    for _ in range(500):
        h = rng.integers(0, 2**63, 900, np.uint64)
        hit += bool((copies.buckets(h[:800]) == copies.buckets(np.concatenate([h[:720], h[800:880]]))).any())
    assert hit >= 495
    print("pairs of 500 that share a bucket:", hit)


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    """Families that share a template, so that all fall into common buckets, with pairs in them that no leader reaches; every component is found."""
    monkeypatch.setattr(copies, "SMALL", 4)
    monkeypatch.setattr(copies, "buckets", lambda h: np.zeros(1, np.int64))  # one bucket for all
    rng = np.random.default_rng(6)
    template = [f"t{x}" for x in range(200)]
    rows = []
    for _ in range(25):
        base = template + [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        rows += [base, edited(rng, base, 3), edited(rng, base, 40)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    root = list(range(len(rows)))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if over(rows[i], rows[j]) >= 0.8]
    for _ in rows:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    got = {r["doc_id"]: r["component_id"] for r in copies.near_copies(docs).collect()}
    assert got == dict(enumerate(root)) and len(near) >= 20


def test_prefixes_find_every_pair(spark):
    """Random sets of shingles around the threshold: each pair of different roots that reaches it is proposed."""
    rng = np.random.default_rng(7)
    words = [[f"v{x}" for x in rng.integers(0, 60, int(rng.integers(1, 60)))] for _ in range(60)]
    words += [edited(rng, w, 1) if len(w) > 2 else w for w in words]
    crowd = spark.createDataFrame([(i, i % 50, " ".join(w)) for i, w in enumerate(words)], "key long, root long, text string")
    sets = [set(copies.shingle_set(" ".join(w))[1].tolist()) for w in words]
    want = {(i, j) for j in range(len(words)) for i in range(j) if i % 50 != j % 50 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = {tuple(r) for r in copies.prefix_pairs(crowd, 5, 0.8).collect()}
    assert want <= got and want and len(got) < 50 * len(want)
