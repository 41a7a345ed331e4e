import random

from pyspark.sql import functions as F

from sellerlens.llm import shingles
from sellerlens.llm.components import components
from tests.llm import cases


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def brute(rows):
    """Components by comparing every pair of sets of word tuples."""
    sets = []
    for d, t in rows:
        w = words(t)
        k = min(5, len(w))
        sets.append((d, {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()))
    ids = sorted({d for d, _ in rows if d is not None})
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=repr)


def test_awkward_documents(spark):
    docs = cases.documents(spark)
    got = [tuple(r) for r in shingles.join(docs).collect()]
    assert sorted(got, key=repr) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert shingles.join(cases.empty(spark)).count() == 0


def edited(r, w, share, pool):
    return [r.choice(pool) if r.random() < share else x for x in w]


def test_groups_of_copies_against_all_pairs(spark, monkeypatch):
    """Copies, near copies around the threshold, shared passages."""
    monkeypatch.setattr(shingles, "SMALL", 3)
    r = random.Random(11)
    pool = [f"w{i}" for i in range(3000)]
    rows, passage = [], r.choices(pool, k=60)
    for _ in range(25):
        base = r.choices(pool, k=r.randint(8, 120))
        for _ in range(r.choice([1, 2, 3, 25])):
            rows.append(" ".join(edited(r, base, r.choice([0, 0, 0.01, 0.03, 0.06]), pool)))
    rows += [" ".join(passage + r.choices(pool, k=r.randint(1, 30))) for _ in range(60)]
    rows = list(enumerate(rows))
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(x) for x in shingles.join(docs).collect()), key=repr)
    assert got == brute(rows)


def test_common_shingles_do_not_change_the_result(spark, monkeypatch):
    r = random.Random(5)
    pool = [f"w{i}" for i in range(500)]
    base = r.choices(pool, k=80)
    rows = [(i, " ".join(edited(r, base, 0.02, pool))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len(shingles.common_shingles(docs)) > 0
    assert sorted((tuple(x) for x in shingles.join(docs).collect()), key=repr) == want


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)]
    edges += edges[:5] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.id: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    none = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    assert components(none).count() == 0


def test_other_text_of_a_copy_still_links(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(3, x), (5, x), (5, y), (9, y + " more")]
    got = sorted((tuple(r) for r in shingles.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows) and {c for _, _, c in got} == {3}


def test_all_pairs_of_the_last_round_lose_no_link(spark, monkeypatch):
    """All pairs of long columns in the last round, without leaders before:
    chains of ever more edited texts, ids with several texts."""
    monkeypatch.setattr(shingles, "SMALL", 2)
    monkeypatch.setattr(shingles, "STARS", 0)
    r = random.Random(21)
    pool = [f"w{i}" for i in range(2000)]
    rows, passage = [], r.choices(pool, k=40)
    for _ in range(4):
        w = r.choices(pool, k=70)
        for _ in range(14):
            w = list(w)
            for _ in range(r.choice([1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(pool)
            rows.append(" ".join(w))
    rows += [" ".join(passage + r.choices(pool, k=r.randint(1, 40))) for _ in range(30)]
    rows = list(enumerate(rows)) + [(2, rows[20]), (60, rows[3] + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(x) for x in shingles.join(docs).collect()), key=repr) == brute(rows)
