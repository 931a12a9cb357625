"""Exact, substring and near dedup against brute force."""

import hashlib
import random
import re

from llm.conftest import TEXTS
from pyspark.sql import functions as F

from tessera.llm.exact_dedup import ContentTable, exact_groups
from tessera.llm.near_dup import connected, near_dup_groups, near_dup_kept
from tessera.llm.substring_dedup import difference_cover, substring_dedup

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_content_table_compares_contents_and_bounds():
    t = ContentTable(capacity_bytes=10)
    assert [t.entry(5, "aaaa", 4), t.entry(5, "bbbb", 4), t.entry(5, "aaaa", 4)] == [0, 1, 0]   # equal hashes
    assert t.entry(6, "cccc", 4) == -1 and t.entry(6, "cccc", 4) == -1
    big = ContentTable()
    assert [big.entry(i * 1024, str(i), 1) for i in range(3000)] == list(range(3000))


def test_exact_groups(docs):
    rows = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in docs.collect()]
    groups = {}
    for d, t in rows:
        groups.setdefault(t, []).append(d)
    want = {d: (min(g), len(g), d == min(g), sha(t)) for t, g in groups.items() for d in g}
    got = {r[0]: tuple(r)[1:] for r in exact_groups(docs).collect()}
    assert got == want


def test_exact_groups_recursion(spark):
    """Buckets that don't fit their table are spilled and partitioned again."""
    rows = [(d, f"text number {d % 37}") for d in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r[0]: tuple(r)[1:3] for r in exact_groups(df, max_entries=4).collect()}
    assert got == {d: (d % 37, 4 if d % 37 < 9 else 3) for d in range(120)}


def test_exact_groups_odd_rows(odd, empty):
    rows = exact_groups(odd).collect()
    assert len(rows) == len(TEXTS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].kept and by[2][0].keep_id == 1 and not by[2][0].kept
    blank = [r for r in rows if r.text_sha256 == sha("")]
    assert len(blank) == 3 and {r.keep_id for r in blank} == {3} and sum(r.kept for r in blank) == 1
    assert sorted(r.kept for r in by[8]) == [False, True] and {r.group_size for r in by[8]} == {2}
    alone = [r for r in by[None] if r.text_sha256 == sha("a row without an id")]
    assert alone[0].keep_id is None and alone[0].kept
    assert exact_groups(empty).count() == 0


def test_difference_cover():
    d = difference_cover(31)
    assert len(d) == 6 and {(a - b) % 31 for a in d for b in d} == set(range(31))


def removed_by_brute_force(rows, width):
    least = {}
    for d, t in sorted(rows):
        w = SPLIT.findall(t or "")
        for i in range(len(w) - width + 1):
            least.setdefault(tuple(w[i:i + width]), d)
    out = {}
    for d, t in rows:
        w = SPLIT.findall(t or "")
        gone = set()
        for i in range(len(w) - width + 1):
            if least[tuple(w[i:i + width])] < d:
                gone.update(range(i, i + width))
        out[d] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substring_dedup_random(spark):
    rng = random.Random(5)
    passage = [[f"p{k}w{i}" for i in range(rng.randint(8, 40))] for k in range(5)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passage)
            a = rng.randint(0, 5)
            words += rng.choice([p, p[a:], [f"u{rng.randint(0, 3)}" for _ in range(rng.randint(1, 9))]])
        rows.append((d, " ".join(words)))
    want = removed_by_brute_force(rows, 10)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r[0]: tuple(r)[1:] for r in substring_dedup(df, width=10, period=7).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 100


def test_substring_dedup_odd_rows(spark, odd, empty):
    rows = substring_dedup(odd).collect()
    assert len(rows) == len(TEXTS)
    eight = [r for r in rows if r.doc_id == 8]
    assert [(r.n_words, r.n_removed) for r in eight] == [(3001, 0)] * 2      # equal ids don't remove
    assert {r.n_words for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert substring_dedup(empty).count() == 0
    w = " ".join(f"w{i}" for i in range(60))
    two = spark.createDataFrame([(None, w), (4, w + " tail"), (9, "head " + w)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup(two).collect()}
    assert got == {4: (0, w + " tail"), 9: (60, "head"), None: (60, "")}


def components_by_brute_force(rows, percent):
    sets = {}
    for d, t in rows:
        w = SPLIT.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def test_near_dup_near_the_threshold(spark):
    """A base with copies of a few edited words: links on both sides of the threshold."""
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(260)]
    rows = []
    for d in range(150):
        w = list(base) if d % 3 else [f"v{rng.randint(0, 300)}" for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 9)):
            if len(w) > 3 and d % 3:
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 9999)}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for percent in (85, 90):
        got = {r[0]: tuple(r)[1:] for r in near_dup_groups(df, percent=percent).collect()}
        assert got == components_by_brute_force(rows, percent)


def test_near_dup_odd_rows(odd, empty):
    rows = near_dup_groups(odd).collect()
    assert len(rows) == len(TEXTS)
    by = {r.doc_id: r for r in rows}
    assert by[2].component_id == 1 and by[10].component_id == 1 and not by[10].kept
    assert by[6].n_shingles == 1 and by[4].n_shingles == 0 and by[4].kept
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert near_dup_groups(empty).count() == 0
    kept = near_dup_kept(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 4, 5, 6, 7, 8, 9, 11]


def test_connected_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in connected(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_pairs_are_not_expanded(spark):
    """A large group of copies keeps the work linear: one class, one node."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g h").alias("text"))
    assert near_dup_groups(df).where("kept").count() == 1
    assert exact_groups(df).where("kept").count() == 1
