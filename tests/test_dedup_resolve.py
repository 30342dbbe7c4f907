import itertools
import random

from pyspark.sql import functions as F

from ecospark.operators import dedup as D
from ecospark.operators import resolve as R


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_similar_pairs_equals_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(40)]
    sets = [set(rng.sample(vocab, rng.randint(1, 12))) for _ in range(60)]
    sets += [set(sets[0]), set(sets[1]) | {"extra"}, set(sets[2])]  # exact and near copies
    rows = [(i, " ".join(sorted(s))) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id long, text string")
    for t in (0.5, 0.7, 0.34):
        got = {(r.id_a, r.id_b): r.similarity for r in D.similar_pairs(df, "id", F.split("text", " "), t).collect()}
        want = {(i, j): _jaccard(sets[i], sets[j]) for i, j in itertools.combinations(range(len(sets)), 2)
                if _jaccard(sets[i], sets[j]) >= t}
        assert set(got) == set(want), t
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_hot_tokens_and_classes(spark, monkeypatch):
    """Posting lists cut to blocks, a set that a third of all rows share, and the compressed form of the links."""
    monkeypatch.setattr(D, "POSTINGS", 4)
    monkeypatch.setattr(D.J, "BROADCAST_ROWS", 0)
    rng = random.Random(3)
    sets = [{"hot", *rng.sample([f"w{i}" for i in range(6)], rng.randint(0, 3))} for _ in range(40)] + [{"hot", "same"}] * 20 + [{f"own{i}"} for i in range(5)]
    df = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in enumerate(sets)], "id long, text string").repartition(3)
    pairs, members = D.similar_representatives(df, "id", F.split("text", " "), 0.5)
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    reps = sorted(first.values())
    want = {(a, b) for a, b in itertools.combinations(reps, 2) if _jaccard(sets[a], sets[b]) >= 0.5}
    got = [(r.a, r.b) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(r.id, r.rep) for r in members.collect()} == {(i, first[frozenset(s)]) for i, s in enumerate(sets)}
    links = {r.id: (r.rep, r.class_size, r.n_links) for r in D.link_counts(pairs, members).collect()}
    for i, s in enumerate(sets):
        assert links[i] == (first[frozenset(s)], sets.count(s), sum(j != i and _jaccard(s, x) >= 0.5 for j, x in enumerate(sets)))


def test_dbscan_components(spark):
    # chain 1-2-3 (1 and 3 not direct neighbours), pair 5-6, singleton 9
    pairs = spark.createDataFrame([(1, 2, 0.6), (2, 3, 0.9), (5, 6, 0.5), (1, 3, 0.2), (6, 9, 0.49)], "a long, b long, similarity double")
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6, 9)], "id long")
    got = {r.id: r.cluster for r in D.cluster(pairs, ids, 0.5).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 5: 1, 6: 1, 9: -1}


def test_components_invariant_under_repartition(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200, 1) if i % 50 != 49], "a long, b long")
    c1 = {r.node: r.label for r in D.connected_components(edges).collect()}
    c2 = {r.node: r.label for r in D.connected_components(edges.repartition(5)).collect()}
    assert c1 == c2
    assert sorted(set(c1.values())) == [0, 50, 100, 150]


def test_activity_cliffs_and_fallback(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.5), (3, 1, 2.0), (4, 1, 2.1), (5, -1, 9.0)], "id int, cl int, v double")
    assert sorted(r.id for r in D.activity_cliffs(df, "cl", "v", 0.2).collect()) == [1, 2]
    assert D.activity_cliffs(df, "cl", "v", 5.0).count() == 5  # no cliff: all rows


def test_stereo_and_dedup(spark):
    df = spark.createDataFrame([(1, "C[C@H](N)O"), (2, "C[C@@H](N)[C@H](O)C"), (3, "CCO")], "k int, smiles string")
    ref = spark.createDataFrame([(1, 1), (2, 1)], "k int, ref_count int")
    out = {r.k: (r.stereo_centres, r.manual_curation) for r in D.stereo_check(df, "smiles", ref, "k").collect()}
    assert out == {1: (1, False), 2: (2, True), 3: (0, True)}
    assert D.stereo_check(df, "smiles", ref, "k", keep=False).count() == 1
    d = spark.createDataFrame([("i1", "c1", 2), ("i1", "c1", 1), ("i1", "c2", 3)], "inchi string, canon string, o int")
    assert sorted(r.o for r in D.compounds(d, "inchi", "canon", ["o"]).collect()) == [1, 3]


LOOKUP = [
    # key, source, priority, value, valid, bits
    ("agree", "PubChem", 0, "X", True, [1, 2]), ("agree", "OPSIN", 1, "X", True, [1, 2]),
    ("differ", "PubChem", 0, "X", True, [1, 2, 3]), ("differ", "OPSIN", 1, "Y", True, [1, 2]),
    ("single", "NIST", 2, "Z", True, [5]),
    ("invalid", "PubChem", 0, "Q", False, [1]),
    ("struct", "PubChem", 0, "A", True, [7, 8]), ("struct", "NCI", 3, "B", True, [7, 8]),
]


def test_resolution_rules(spark):
    lk = spark.createDataFrame(LOOKUP, "key string, source string, priority int, value string, valid boolean, bits array<int>")
    keys = lk.select("key").distinct()
    pr = {r.key: r.value for r in R.by_priority(keys, lk).collect()}
    assert pr == {"agree": "X", "differ": "X", "single": "Z", "invalid": None, "struct": "A"}
    cons = {r.key: r.value for r in R.consensus(lk).collect()}
    assert cons == {"agree": "X", "differ": None, "single": "Z", "invalid": None, "struct": None}
    st = {r.key: r.notes for r in R.consensus_status(lk).collect()}
    assert st["agree"] == "Match from multiple sources: ['PubChem', 'OPSIN']"
    assert st["differ"] == "Structure mismatch (average similarity: 0.67)"
    assert st["struct"] == "Structural match from multiple sources after comparison"
    assert st["single"] == "" and st["invalid"] == "No valid InChI found"


def test_fallback_chain(spark):
    keys = spark.createDataFrame([(1, "aspirin", "50782"), (2, "nothing", "64175"), (3, "none", "1")], "key int, name string, cas string")
    from ecospark.functions.clean import format_cas

    ref = spark.createDataFrame([("aspirin", "I1"), ("64-17-5", "I2")], "name string, value string")
    out = {r.key: (r.value, r.stage) for r in R.fallback_chain(
        keys, ref, [("name", F.col("name")), ("formatted CAS", format_cas("cas"))]).collect()}
    assert out == {1: ("I1", "name"), 2: ("I2", "formatted CAS"), 3: (None, "unresolved")}


def test_components_of_chains_stars_and_groups(spark):
    import random

    rng = random.Random(1)
    edges, truth = [], {}
    for k in range(12):  # chains, stars, cycles and random trees with shuffled names, plus loops and repeats
        nodes = rng.sample(range(k * 1000, k * 1000 + 999), 40)
        for i in range(1, 40):
            j = i - 1 if k % 3 == 0 else 0 if k % 3 == 1 else rng.randrange(i)
            edges.append((nodes[i], nodes[j]))
        edges += [(nodes[5], nodes[5]), edges[-1]]
        truth.update(dict.fromkeys(nodes, min(nodes)))
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.label for r in D.connected_components(df).collect()} == truth
    two = df.selectExpr("'g' AS g", "a", "b").unionByName(spark.createDataFrame([("h", 1, 2), ("h", 2, 5)], "g string, a long, b long"))
    got = {(r.g, r.node): r.label for r in D.connected_components(two, group=["g"]).collect()}
    assert got == {("g", k): v for k, v in truth.items()} | {("h", 1): 1, ("h", 2): 1, ("h", 5): 1}
    assert D.connected_components(df.limit(0)).count() == 0


def test_blocks_of_every_size_class_and_split_counts(spark, monkeypatch):
    """Sizes from 1 to 60 over many size classes, blocks of a few sets, and counting in chunks of a few cells and matches; a pair
    of sets is compared only where their blocks meet, and no join on tokens makes candidates."""
    for name, value in (("POSTINGS", 5), ("BLOCK_TOKENS", 60), ("CELLS", 16), ("MATCHES", 7)):
        monkeypatch.setattr(D, name, value)
    rng = random.Random(11)
    sets = [set(rng.sample([f"w{i}" for i in range(70)], n)) for n in (1, 1, 2, 3, 5, 9, 17, 30, 33, 50, 60) for _ in range(3)]
    sets += [set(s) - {min(s)} | {"x"} for s in sets[6:]] + [set(sets[-1]), {"x"}]
    df = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in enumerate(sets)], "id long, text string").repartition(3)
    for t in (0.2, 0.5, 0.9, 1.0):
        got = [(r.id_a, r.id_b, round(r.similarity, 9)) for r in D.similar_pairs(df, "id", F.split("text", " "), t).collect()]
        want = {(i, j, round(_jaccard(sets[i], sets[j]), 9)) for i, j in itertools.combinations(range(len(sets)), 2) if _jaccard(sets[i], sets[j]) >= t}
        assert len(got) == len(set(got)) and set(got) == want, t
    pairs, _ = D.similar_representatives(df, "id", F.split("text", " "), 0.5)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "posexplode" not in plan


def test_pair_queries_hold_copies_and_links(spark, tmp_path):
    """pairs of copies are rows of the pair queries; the compressed forms are queries of their own."""
    from ecospark.plans import registry

    registry.load_all()
    texts = ["a b c", "a b c", "c b a", "a b d e f g h", "x y"]
    spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: sorted(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
    same = [(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0)]
    assert run("C5_similar_pairs") == same and run("C5_representative_pairs") == []
    assert run("J8_similarity_self_join") == sorted([(1000 + a, 1000 + b, s) for a, b, s in same] + [(1000 + i, 1003, 0.25) for i in range(3)])
    assert run("J8_representative_pairs") == [(1000, 1003, 0.25)]
    links = registry.QUERIES["J8_similar_links"](spark, str(tmp_path)).select("id", "rep", "class_size", "n_links")
    assert sorted(tuple(r) for r in links.collect()) == [(1000, 1000, 3, 3), (1001, 1000, 3, 3), (1002, 1000, 3, 3), (1003, 1003, 1, 3), (1004, 1004, 1, 0)]


def test_blocks_hold_every_set_once(spark, monkeypatch):
    """The blocks that meet are read where they lie, and no set is written once per block that its block meets; tokens whose codes
    collide under one seed, copies folded before they are dealt, and tokens that every task knows change no pair."""
    for name, value in (("POSTINGS", 6), ("CODE_BITS", 12), ("COPIES", 3), ("FREQUENT", 9), ("FOUND", 2)):
        monkeypatch.setattr(D, name, value)
    rng = random.Random(5)
    sets = [set(rng.sample([f"w{i}" for i in range(60)], n)) for n in (4, 6, 9) for _ in range(5)]
    sets += [sets[k] - {min(sets[k])} for k in range(3, 9)] + [sets[0]] * 6 + [sets[7]]
    df = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in enumerate(sets)], "id long, text string").repartition(3)
    one, names, _ = D._collapse(D.token_sets(df, "id", F.split("text", " ")))
    blocks = D._blocks(one, names, 0.4).collect()
    distinct = {frozenset(s): i for i, s in reversed(list(enumerate(sets)))}
    assert len(blocks) > 2 and sorted(i for b in blocks for i in b.reps) == sorted(distinct.values())
    pairs, _ = D.similar_representatives(df, "id", F.split("text", " "), 0.4)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and plan.count("Exchange") == 1
    want = {(i, j, round(_jaccard(a, b), 9)) for (a, i), (b, j) in itertools.combinations(sorted(distinct.items(), key=lambda x: x[1]), 2) if _jaccard(a, b) >= 0.4}
    assert {(r.a, r.b, round(r.similarity, 9)) for r in pairs.collect()} == want


def test_pairs_and_links_leave_no_pair_to_a_shuffle(spark, monkeypatch):
    """Copies, near copies, unknown and repeated ids: rows are paired and links counted where the blocks meet."""
    monkeypatch.setattr(D, "POSTINGS", 4)
    monkeypatch.setattr(D, "FOUND", 7)
    rng = random.Random(11)
    sets = [frozenset(rng.sample([f"w{i}" for i in range(9)], rng.randint(2, 5))) for _ in range(25)] * 3 + [frozenset({"a", "b"})] * 30
    rows = [(i, " ".join(sorted(s))) for i, s in enumerate(sets)]
    known = spark.createDataFrame(rows, "id long, text string").repartition(3)
    want = {(i, j): _jaccard(sets[i], sets[j]) for i, j in itertools.combinations(range(len(sets)), 2) if _jaccard(sets[i], sets[j]) >= 0.5}
    first = {s: i for i, s in reversed(list(enumerate(sets)))}
    for copies, representatives in ((1000, 1_000_000), (10, 1_000_000), (10, 0)):
        monkeypatch.setattr(D, "COPIES", copies)
        monkeypatch.setattr(D, "REPRESENTATIVES", representatives)
        out = D.similar_pairs(known, "id", F.split("text", " "), 0.5)
        if copies > 30:
            assert not any(x in out._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "SortMergeJoin"))
        got = [(r.id_a, r.id_b, r.similarity) for r in out.collect()]
        assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want
        links = {r.id: (r.rep, r.class_size, r.n_links) for r in D.similar_links(known, "id", F.split("text", " "), 0.5).collect()}
        assert links == {i: (first[s], sets.count(s), sum((min(i, j), max(i, j)) in want for j in range(len(sets)) if j != i)) for i, s in enumerate(sets)}
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a b"), (None, "a b")], "id long, text string")
    assert [(r.id_a, r.id_b) for r in D.similar_pairs(twice, "id", F.split("text", " "), 0.5).collect()] == [(1, 2)] * 2
