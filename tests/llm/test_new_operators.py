"""Grid order join, Merkle manifest and importance resampling against plain versions and their SQL."""

import math
import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from veilscan.llm import grid_order, merkle, queries, resample

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_embedding_near_dedup", "op12_merkle_manifest", "op13_importance_resampling"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    want = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SMALL).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and got


# ---- grid order join


def all_pairs(rows, least):
    """(vec_id, n_links, component_id, kept) by comparing every pair."""
    parent, links, groups = list(range(len(rows))), [0] * len(rows), defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (v, label, e) in enumerate(rows):
        if v is not None and label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            groups[label, len(e)].append(i)
    for some in groups.values():
        u = np.array([rows[i][2] for i in some])
        u = u / np.abs(u).max(1)[:, None]
        u = u / np.linalg.norm(u, axis=1)[:, None]
        hit = u @ u.T >= least
        np.fill_diagonal(hit, False)
        for a, b in np.argwhere(hit).tolist():
            links[some[a]] += 1
            parent[find(some[a])] = find(some[b])
    low = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            low[find(i)] = min(low.get(find(i), v), v)
    return sorted(((v, links[i], low.get(find(i)), v == low.get(find(i))) for i, (v, _, _) in enumerate(rows)), key=str)


def vectors():
    random.seed(3)
    rows = []
    for k in range(700):
        wide = [random.gauss(0, 1) for _ in range(6)]
        near = [c + random.gauss(0, 0.02 if k % 2 else 0.2) for c in (1, 0.2, 0.1, 0, 0, 0)]
        rows.append((k, str(k % 2) if k % 5 else "hot", near if k % 3 else wide))
    copies = [(700 + k, rows[k * 7][1], rows[k * 7][2]) for k in range(20)]
    odd = [None, [0.0] * 6, [1.0, float("nan"), 0.0], [float("inf"), 1.0], [], [1.0, None], [1.0, 2.0], [1.0, 2.1], [1e200, 2e200], [-0.0, 1.0], [0.0, 1.0]]
    return [*rows, *copies, copies[0], *((900 + k, "hot", v) for k, v in enumerate(odd)), (950, None, [1.0] * 6), (951, "0", [1.0] * 6)]


def test_grid_order_join_equals_all_pairs(spark):
    """In blocks so small that intervals nest on several levels."""
    grid, rows = grid_order.Grid(block=32, leaf=8, fan=3, axes=3), vectors()
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "vec_id long, label string, embedding array<double>, n_links double, key string")
    got = sorted((tuple(r) for r in grid_order.near_duplicates(df, grid).collect()), key=str)
    assert got == all_pairs(rows, grid.least)


def test_grid_order_join_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert grid_order.near_duplicates(df).collect() == []


def test_intervals_end_early():
    """Two dense groups: their inner pairs are counted as near, the pairs between them skipped as distant."""
    random_ = np.random.default_rng(5)
    groups = [c + 0.01 * random_.normal(size=(256, 8)) for c in (np.eye(8)[0], np.eye(8)[1])]
    rows = np.concatenate(groups)
    block = grid_order.Block(rows, np.ones(512, np.int64), grid_order.unit(rows)[:, :2], np.arange(512), 32)
    union = grid_order.Union(512)
    grid_order.joined_intervals(block, block, grid_order.Grid(leaf=32), union, 0)
    assert block.links.tolist() == [255] * 512
    assert len({union.find(i) for i in range(512)}) == 2


def test_a_pair_at_the_bound_is_decided_by_its_cosine():
    a, b = np.array([1.0, 0.0]), np.array([0.93, math.sqrt(1 - 0.93**2)])
    least = grid_order.cosine(a, b)
    rows = np.array([a, b])
    for bound, n in ((least, 1), (np.nextafter(least, 2), 0)):
        block = grid_order.Block(rows, np.ones(2, np.int64), rows, np.arange(2), 8)
        grid_order.joined_intervals(block, block, grid_order.Grid(least=bound), grid_order.Union(2), 0)
        assert block.links.tolist() == [n, n]


# ---- Merkle manifest


def text_digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return text_digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """The root of nodes and each one's siblings on the way there."""
    proofs, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 3, len(nodes))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for k in run:
                for leaf in below[k]:
                    proofs[leaf] += [nodes[j] for j in run if j != k]
        nodes, below = [text_digest(*(nodes[k] for k in run)) for run in runs], [[x for k in run for x in below[k]] for run in runs]
    return nodes[0], proofs


def plain_manifest(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append(r)
    names, trees = sorted(sources, key=lambda s: (s is not None, (s or "").encode())), {}
    for s, some in sources.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = plain_tree([plain_leaf(r) for r in some])
    root, proofs = plain_tree([trees[s][0] for s in names])
    out = []
    for s, upper in zip(names, proofs):
        for r, proof in zip(sources[s], trees[s][1]):
            changed = r[0] is not None and r[4] is not None and "\n" in r[4] and zlib.crc32(str(r[0]).encode()) % 2 == 0
            out.append((r[0], plain_leaf(r), trees[s][0], root, text_digest(*proof, *upper), not changed))
    return sorted(out, key=str)


def documents(n):
    random.seed(n)
    names = [None, "a", "b", "hot", "hot", "hot", "ä", "", "Z"]
    rows = [(k, random.choice(names), "en" if k % 3 else None, k % 7 or None, random.choice(["x\ny", "plain", "", None, "é\n", "long " * 5000])) for k in range(n)]
    return [*rows, rows[0], (None, "hot", None, None, "a\nb"), (7, "hot", "en", 1, "again\n")]


@pytest.mark.parametrize("power", [1, 8])
def test_manifest_equals_plain_tree(spark, power):
    rows = documents(120)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, rank int, root string")
    got = merkle.manifest(df, power).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in got), key=str) == plain_manifest(rows)
    assert all((r.folded_root == r.root) == r.verified for r in got) and not all(r.verified for r in got)


def test_manifest_of_one_and_of_none(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    (one,) = merkle.manifest(spark.createDataFrame([(5, None, None, None, None)], schema)).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root == plain_leaf((5, None, None, None, None))
    assert one.verified and one.proof_sha256 == text_digest()
    assert merkle.manifest(spark.createDataFrame([], schema)).count() == 0


def test_append_extends_witnesses_as_runs_close():
    tree, nodes = merkle.Append(), [bytes([k]) * 32 for k in range(5)]
    for k, node in enumerate(nodes):
        tree.append(node)
        assert [len(w) // 32 for w in tree.witnesses] == [[0], [0, 0], [2, 2, 2], [2, 2, 2, 0], [2, 2, 2, 0, 0]][k]
    root = tree.finish(merkle.levels_of(5))
    assert [len(w) // 32 for w in tree.witnesses] == [3, 3, 3, 2, 2]
    assert all(merkle.folded(n, k, 5, bytes(tree.witnesses[k])) == (root, len(tree.witnesses[k])) for k, n in enumerate(nodes))


# ---- importance resampling


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split(" ")


def plain_grams(text, longest):
    words = [w for w in plain_words(text) if w]
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def plain_resampled(rows, target, plan):
    def bucket(g):
        return zlib.crc32(g.encode()) % plan.buckets

    s = Counter(bucket(g) for _, t in rows for g in plain_grams(t, plan.longest)[0])
    t = Counter(bucket(g) for x in target for g in plain_grams(x, plan.longest)[0])
    out = []
    for doc, text in rows:
        found, words = plain_grams(text, plan.longest)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s.total() + plan.buckets) / ((s[b] + 1) * (t.total() + plan.buckets)))) for b in map(bucket, found))
        h = int(sha256(f"{plan.seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words))
    enough = sorted((r for r in out if r[4] >= plan.least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], r[1]))
    drawn = enough[: len(enough) * plan.percent // 100]
    ranks = [(*r[:4], k + 1) for k, r in enumerate(drawn)]
    left = Counter(out) - Counter(drawn)
    return sorted([*ranks, *((*r[:4], None) for r in left.elements())], key=str)


@pytest.mark.parametrize("plan", [resample.Plan(), resample.Plan(longest=3, buckets=97, least=3, percent=40, seed=1)])
def test_resampling_equals_plain_version(spark, plan):
    random.seed(9)
    words = ["Alpha", "beta", "gamma", "Straße", "ünï", "x1", "日本", "it's", "a\x1cb", " ", "A"]
    rows = [(k, " ".join(random.choices(words, k=random.choice([0, 1, 5, 19, 20, 60])))) for k in range(150)]
    rows += [(150, None), (151, ""), (152, " \n--"), (None, "beta " * 30), (3, rows[3][1]), (4, "gamma;" * 40), (153, "w" * 300 + " beta" * 25), (154, "alpha beta " * 40_000)]
    target = ["alpha alpha Beta", None, "", "new words, alpha"]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, rank int, short string")
    got = resample.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), plan).collect()
    assert sorted(map(tuple, got), key=str) == plain_resampled(rows, target, plan)


def test_resampling_without_documents_or_target(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert resample.resampled(empty, docs).count() == 0
    plan = resample.Plan(least=1, percent=100)
    assert sorted(map(tuple, resample.resampled(docs, empty, plan).collect()), key=str) == plain_resampled([(1, "a b"), (2, None)], [], plan)
    assert [r.doc_id for r in resample.selected(docs, empty, plan).collect()] == [1]


def test_scan_emits_overlapping_spans():
    text = resample.collapsed(b" The  quick,brown--fox\xc3\xa9 ")
    assert text == b"the quick brown fox\xc3\xa9"
    assert list(resample.grams(text, 2)) == [b"the", b"quick", b"brown", b"fox\xc3\xa9", b"the quick", b"quick brown", b"brown fox\xc3\xa9"]
