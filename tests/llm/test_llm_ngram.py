import numpy as np
from llm_helpers import DOCS, invented, near_classes, shingles

from keyfold.llm import ngram_join as N
from keyfold.llm.components import components


def check(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCS).repartition(3)
    got = {r["id"]: (r["n"], r["component"]) for r in N.classes(df).collect()}
    want = near_classes(texts)
    assert got == {i: (len(shingles(t)), want[i]) for i, t in texts.items()}


def test_equals_all_pairs(spark):
    texts = dict(enumerate(invented(160)))
    texts |= {900: "", 901: None, 902: " \t\n", 903: "one two", 904: "One  two", 905: "a b c d e", 906: "A b c d e f", 907: ("w%d " * 1) % 1}
    texts[908] = " ".join(f"w{i}" for i in range(20000))
    texts[909] = " ".join(f"w{i}" for i in range(18000))
    check(spark, texts)


def test_chain_of_near_copies_is_one_component(spark):
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for k in range(12):  # each link holds, the ends share little
        base[5 * k] = f"v{k}"
        texts[100 - k] = " ".join(base)
    check(spark, texts)


def test_null_ids_repeats_clashing_columns_and_empty(spark):
    schema = "doc_id bigint, text string, rep int, key int, n int, label int, id int, a int, b int"
    t = "a b c d e f g h"
    rows = [(None, t), (4, t), (2, t), (2, t), (9, "q")]
    got = N.classes(spark.createDataFrame([(*r, *[0] * 7) for r in rows], schema)).collect()
    assert sorted(((r["id"], r["n"], r["component"]) for r in got), key=repr) == sorted(
        [(None, 4, None), (4, 4, 2), (2, 4, 2), (2, 4, 2), (9, 1, 9)], key=repr
    )
    assert N.classes(spark.createDataFrame([], schema)).count() == 0


def shared_ids():
    """Rows of which some share an id with another text, and their components."""
    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(5, x), (5, y), (7, x + " more"), (8, y + " more"), (3, z), (8, z + " more"), (4, "q r s"), (8, "q r s"), (5, "alone here")]
    return rows, [5, 5, 5, 5, 3, 3, 4, 4, 5]


def test_rows_that_share_an_id_have_the_component_of_their_own_text(spark):
    rows, want = shared_ids()
    for turn in range(2):  # in either order
        df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows[:: 1 - 2 * turn]], DOCS)
        got = sorted((r["id"], r["n"], r["component"]) for r in N.classes(df).collect())
        assert got == sorted((i, len(shingles(t)), c) for (i, t), c in zip(rows, want))


def test_the_stage_drops_rows_by_their_own_text(spark):
    import corpus_pipeline

    rows, want = shared_ids()
    rows, want = [*rows, (8, "clean text of its own"), (None, rows[0][1]), (9, None)], [*want, 8, None, 9]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    out = corpus_pipeline.drop_near_copies(spark, df, "")
    assert out.columns == df.columns
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key) == sorted((r for r, c in zip(rows, want) if r[0] == c), key=key)


def test_tree_join_finds_every_pair_under_the_bound():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(1, 80), dtype=np.uint64)) for _ in range(150)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 2**63, 2, dtype=np.uint64)])) for s in sets]
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    vec = np.stack([np.bincount((s << np.uint64(1) >> np.uint64(56)).astype(int), minlength=N.GROUPS) for s in sets]).astype("u1")
    ids, label = np.arange(len(sets)), np.arange(len(sets))
    tree = N._tree(n.tobytes(), ids.tobytes(), label.tobytes(), vec.tobytes())
    found = {tuple(sorted(p)) for a, b in N.tree_join(tree, None, 75) for p in zip(a.tolist(), b.tolist())}
    for i in range(len(sets)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 100 * shared >= 75 * (n[i] + n[j] - shared):
                assert (j, i) in found
    assert len(found) < len(sets) ** 2 / 8


def test_prefix_is_exact_for_small_sets():
    assert [N.prefix_length(n, 75) for n in (1, 4, 8, 1000)] == [1, 2, 3, 32]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 10), (10, 11), (20, 21)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def family(rng, n, size=120, edits=30):
    """Sets that each differ from one base in some hashes: links and near misses."""
    base = rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2)
    out = []
    for _ in range(n):
        s = base.copy()
        at = rng.choice(size, rng.integers(0, edits), replace=False)
        s[at] = rng.integers(0, 2**63, len(at), dtype=np.uint64)
        out.append(np.unique(s))
    return out


def tile_of(sets, first, label=None):
    """A tree of the sets in spatial order, and the sets by node."""
    vec = N.points([N._counts(s) for s in sets])
    order = N._spatial(vec)
    rep = order + first
    own = N._padded([sets[i][: N.prefix_length(len(sets[i]), 75)] for i in order])
    n = np.array([len(sets[i]) for i in order])
    label = rep if label is None else label[order]
    return N.Tree(*(x.tobytes() for x in (n, rep, label, np.ascontiguousarray(vec[order]), own)))


def linked(x, y):
    shared = len(np.intersect1d(x, y))
    return shared > 0 and 100 * shared >= 75 * (len(x) + len(y) - shared)


def test_trees_of_several_levels_meet_as_all_pairs_do():
    rng = np.random.default_rng(11)
    left = family(rng, 150) + family(rng, 40, 900, 300)
    right = family(rng, 20) + left[:70] + family(rng, 8, 30, 9)
    x, y = tile_of(left, 0), tile_of(right, 1000, np.arange(1000, 1000 + len(right)))
    assert len(x.levels) >= 2 and x.levels[-1][1][0].shape == (1,)
    sets = dict(enumerate(left)) | {1000 + i: s for i, s in enumerate(right)}
    across = {(a, b) for i, j in N.meeting(x, y, 75) for a, b in zip(x.rep[i].tolist(), y.rep[j].tolist())}
    assert {(a, b) for a in range(len(left)) for b in range(1000, 1000 + len(right)) if linked(sets[a], sets[b])} <= across
    within = {tuple(sorted(p)) for i, j in N.meeting(x, None, 75) for p in zip(x.rep[i].tolist(), x.rep[j].tolist())}
    assert {(a, b) for b in range(len(left)) for a in range(b) if linked(left[a], left[b])} <= within


def test_each_pair_is_met_in_the_block_of_its_smallest_common_hash():
    rng = np.random.default_rng(2)
    sets = family(rng, 60)
    tile = tile_of(sets, 0)
    every = [tuple(sorted(p)) for i, j in N.meeting(tile, None, 75) for p in zip(tile.rep[i].tolist(), tile.rep[j].tolist())]
    keys = sorted({int(k) for k in np.unique(tile.keys)})
    owned = []
    for key in keys:
        inside = np.array([(k == np.uint64(key)).any() for k in tile.keys])
        for i, j in N.meeting(tile, None, 75, key):
            both = inside[i] & inside[j]
            owned += [tuple(sorted(p)) for p in zip(tile.rep[i][both].tolist(), tile.rep[j][both].tolist())]
    # pairs without a common hash cannot link; all others are met exactly once
    assert len(owned) == len(set(owned))
    own = {r: set(k.tolist()) for r, k in zip(tile.rep.tolist(), tile.keys)}
    assert set(owned) == {p for p in every if own[p[0]] & own[p[1]]}


def test_a_family_settles_with_fewer_links_than_rows():
    rng = np.random.default_rng(3)
    sets = family(rng, 300)
    rep = label = np.arange(300)
    up = list(range(300))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for b in range(300):
        for a in range(b):
            if linked(sets[a], sets[b]):
                up[root(b)] = root(a)
    want = {}
    for i in range(300):
        want.setdefault(root(i), set()).add(i)
    parts = {i: {i} for i in range(300)}
    total = 0
    key_of = sorted({int(k) for s in sets for k in s[: N.prefix_length(len(s), 75)]})
    for key in key_of:  # every block of the family
        rows = [i for i, s in enumerate(sets) if np.uint64(key) in s[: N.prefix_length(len(s), 75)]]
        if len(rows) < 2:
            continue
        found = N.settled(key, np.zeros(len(rows), np.int64), rep[rows], label[rows], [sets[i] for i in rows], 75)
        assert len(found) < len(rows)
        total += len(found)
        for a, b in found:
            assert linked(sets[a], sets[b])
            joined = parts[a] | parts[b]
            for m in joined:
                parts[m] = joined
    assert {frozenset(p) for p in parts.values()} == {frozenset(w) for w in want.values()}
    sides = (np.arange(300) % 2).astype(np.int64)
    across = N.settled(key_of[0], sides, rep, label, sets, 75)
    assert all(a % 2 != b % 2 and linked(sets[a], sets[b]) for a, b in across) and len(across) < 300
