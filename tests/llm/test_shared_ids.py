"""Near joins of tables whose ids repeat, against all pairs in plain Python."""

import random

from tessera.llm import nearjoin
from tessera.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.01"


def words(seed, n=60):
    rng = random.Random(seed)
    return [f"w{rng.randint(0, 9999)}" for _ in range(n)]


def near(w, k):
    return [*w[:k], "changed", *w[k + 1 :]]


def got(spark, rows):
    return {(r.doc_id, r.component_id) for r in nearjoin.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_unlike_sets_of_one_size_under_one_id(spark):
    a, b = words(1), words(2)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(near(a, 59))), (3, " ".join(near(b, 59))), (4, " ".join(words(3)))]
    assert got(spark, rows) == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_ids_tie_classes_of_smaller_documents(spark):
    a, b = words(1), words(2)
    # 5 holds both sets, whose smallest documents are 1 and 2; 7 is near 2's
    rows = [(5, " ".join(a)), (5, " ".join(b)), (1, " ".join(a)), (2, " ".join(b)), (7, " ".join(near(b, 0))), (9, " ".join(words(4)))]
    assert got(spark, rows) == {(5, 1), (1, 1), (2, 1), (7, 1), (9, 9)}


def test_random_tables_with_shared_ids(spark):
    rng = random.Random(6)
    base = [words(k, 50) for k in range(12)]
    rows = []
    for _ in range(90):
        w = rng.choice(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w = near(w, rng.randint(0, 49))
        rows.append((rng.randint(0, 70), " ".join(w)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(46)} for _, t in rows]
    top = {d: d for d, _ in rows}

    def find(x):
        return x if top[x] == x else find(top[x])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(rows[i][0]), find(rows[j][0])
                top[max(x, y)] = min(x, y)
    assert got(spark, rows) == {(d, find(d)) for d, _ in rows}


def test_whole_table_against_sql(spark, same):
    same(QUERIES["op10_near_join"](spark, SMALL), SQL["op10_near_join"], SMALL)


def test_counts_of_a_very_large_group(spark):
    import numpy as np

    s = np.arange(70_000, dtype=np.uint64)  # all in the first group
    assert nearjoin.count_vector(s)[0] == 70_000 and nearjoin._points([nearjoin.count_vector(s).tobytes()])[0, 0] == 70_000
