"""Embedding near-dedup (operator 5): range search in a robust-pruned flat graph.

Vectors are compared within a label only. Equal vectors of a label are one node with a weight. Per label, a sample of
nodes serves as cluster centres; every node belongs to the ``overlap`` nearest clusters of its label, so clusters
overlap. A cluster with more than ``CAP`` nodes (a dense clump can be a third of all rows) is cut into shards by a
hash.

*Build.* In every shard each node's nearest nodes are robust-pruned: a candidate is kept unless a neighbour kept
before is closer to it, by the factor ``ALPHA``, than the node itself. The adjacency lists of a node from all its
shards, and their reverse edges, are united.

*Search.* Every node queries every shard of its clusters: greedy best-first from the shard's medoid over the united
lists; once the beam holds nothing better, everything found within the range is expanded until the range has no
unseen neighbour. Shards of a cluster meet pairwise, so no clump lies in one task.

*Verify and link.* Only pairs whose cosine in double precision reaches the threshold count, each in the first cluster
that both nodes share. A task returns link counts and a spanning forest of its links, never the pairs. Components
are united over all tasks.

*Audit.* Probes are compared with all nodes of their label by brute force. While fewer than ``RECALL`` of the probes that have
links found all of theirs, the search is repeated with twice the overlap; too few linked probes are no evidence and
widen the overlap to ``SAFE``.

Rows whose label or vector is null, whose vector is zero or empty or holds a null or a non-finite component link with
nothing. Rows that repeat a vec_id are rows of their own; null ids take part, and a component is named by its
smallest id that isn't null. Vectors of different lengths never link. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecospark.llm.tables import column, stored
from ecospark.operators.dedup import connected_components

#: nodes per cluster (wanted); most clusters over all labels; nodes per shard
CLUSTER, CENTRES, CAP = 400, 16_000, 2000
#: candidates, neighbours kept, pruning factor, beam width
NEAR, DEGREE, ALPHA, BEAM = 48, 16, 1.2, 24
#: probes of the audit at first and at most, those with links that make a verdict, share of them with all links found
AUDIT, PROBES, EVIDENCE, RECALL = 200, 3200, 20, 0.95
#: clusters of a node at first, and those that pass without enough evidence (0.997 of isolated pairs share one of 4 in a simulation)
OVERLAP, SAFE = 4, 8


def nodes_of(table: DataFrame, id_col: str, label_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``(row, id, node)`` (null node: links with nothing) and nodes ``(node, label, unit, weight)``; ``unit`` is the
    vector of length one as little-endian doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = []
            for label, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = np.array([np.nan if y is None else y for y in v], dtype="<f8") if v and label is not None else np.zeros(0)
                top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
                x = x / top if top > 0 else x[:0]  # scaled first, so that squares neither overflow nor vanish
                units.append((x / np.sqrt(x @ x)).astype("<f8").tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(units, pa.binary())], names=["id", "label", "unit"])

    rows = table.select(column(table, id_col, "long").alias("id"), column(table, label_col, "string").alias("label"),
                        column(table, vector_col, "array<double>").alias("v")).mapInArrow(run, "id long, label string, unit binary")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    good = rows.filter("unit IS NOT NULL")
    nodes = stored(good.groupBy("label", "unit").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("weight")))
    keys = good.select("row", "label", "unit").join(nodes.select("label", "unit", "node"), ["label", "unit"]).select("row", "node")
    return rows.select("row", "id").join(keys, "row", "left"), nodes


def _matrix(units: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(units), dtype="<f8").reshape(len(units), -1)


def centres_of(nodes: DataFrame) -> dict[str, list[np.ndarray]]:
    """Cluster centres by label: a hash sample of the nodes, about one in ``CLUSTER`` and ``CENTRES`` at most (expected)."""
    total = nodes.count()
    share = min(1.0 / CLUSTER, CENTRES / max(total, 1))
    draw = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    out: dict[str, list[np.ndarray]] = {}
    for r in nodes.filter(draw < share).select("label", "unit").toLocalIterator():
        out.setdefault(r["label"], []).append(np.frombuffer(r["unit"], dtype="<f8"))
    return out


def clustered(nodes: DataFrame, centres: dict[str, list[np.ndarray]], overlap: int) -> DataFrame:
    """``(node, label, dim, unit, weight, clusters, cluster)``: a row per node and cluster; ``clusters`` lists all of a node's."""
    stacked: dict[tuple[str, int], np.ndarray] = {}
    for label, own in centres.items():
        for dim in {len(y) for y in own}:
            stacked[label, dim] = np.stack([y for y in own if len(y) == dim])
    shared = nodes.sparkSession.sparkContext.broadcast(stacked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units, near, same = b.column(2).to_pylist(), [[-1]] * b.num_rows, {}
            for i, (label, unit) in enumerate(zip(b.column(1).to_pylist(), units, strict=True)):
                same.setdefault((label, len(unit) // 8), []).append(i)
            for key, rows in same.items():
                if key in shared.value:
                    close = np.argsort(-(_matrix([units[i] for i in rows]) @ shared.value[key].T), axis=1, kind="stable")[:, :overlap]
                    for i, k in zip(rows, close.tolist(), strict=True):
                        near[i] = k
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.list_(pa.int32()))], names=["node", "label", "unit", "weight", "clusters"])

    out = nodes.select("node", "label", "unit", "weight").mapInArrow(run, "node long, label string, unit binary, weight long, clusters array<int>")
    out = out.withColumn("cluster", F.explode("clusters")).withColumn("dim", F.length("unit"))
    size = out.groupBy("label", "dim", "cluster").agg(F.ceil(F.count(F.lit(1)) / CAP).alias("shards"))
    return stored(out.join(size, ["label", "dim", "cluster"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")))


# ---------------------------------------------------------------- graph


def pruned(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Robust-pruned edges (from, to) of a shard's nodes."""
    n = len(x)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    far = 1.0 - x @ x.T
    np.fill_diagonal(far, np.inf)
    k = min(NEAR, n - 1)
    near = np.argpartition(far, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, axis=1), axis=1), axis=1)
    dist, alive, picked = np.take_along_axis(far, near, axis=1), np.ones((n, k), bool), []
    rows = np.arange(n)
    for _ in range(min(DEGREE, k)):
        has = alive.any(axis=1)
        first = alive.argmax(axis=1)
        to = near[rows, first]
        picked.append((rows[has], to[has]))
        alive[rows, first] = False
        alive &= ~((ALPHA * far[to[:, None], near] <= dist) & has[:, None])
        if not alive.any():
            break
    return np.concatenate([p[0] for p in picked]), np.concatenate([p[1] for p in picked])


def graph(cells: DataFrame) -> DataFrame:
    """``(node, near)``: the united adjacency lists."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        ids = part["node"].to_numpy()
        a, b = pruned(_matrix(part["unit"].tolist()))
        return pd.DataFrame({"node": np.concatenate([ids[a], ids[b]]), "to": np.concatenate([ids[b], ids[a]])})

    edges = cells.groupBy("label", "dim", "cluster", "shard").applyInPandas(build, "node long, to long")
    return edges.distinct().groupBy("node").agg(F.collect_list("to").alias("near"))


def _around(near: tuple[np.ndarray, np.ndarray], who: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``who`` and neighbour of every neighbour of the nodes; ``near`` holds the bounds of each node's neighbours and all of them."""
    bounds, flat = near
    n = bounds[node + 1] - bounds[node]
    return np.repeat(who, n), flat[np.repeat(bounds[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _range_search(q: np.ndarray, x: np.ndarray, near: tuple[np.ndarray, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) with cosine >= ``least`` that the graph leads to, and nothing else. A step costs a query what it meets: its beam
    and the new neighbours of the nodes expanded, not the shard's nodes."""
    n = len(x)
    # nodes that no edge reaches from the medoid are started from as well
    seen, starts = np.zeros(n, bool), []
    front = np.array([int((x @ x.mean(axis=0)).argmax())])
    while True:
        starts.append(int(front[0]))
        while len(front):
            seen[front] = True
            to = np.unique(_around(near, front, front)[1])
            front = to[~seen[to]]
        rest = np.flatnonzero(~seen)
        if not len(rest):
            break
        front = rest[:1]
    hits, far = [], 2 * least - 1 - 1e-9
    for cut in range(0, len(q), 256):
        part = q[cut : cut + 256]
        m = len(part)
        met, slot = np.zeros((m, n), bool), np.zeros((m, n), np.int32)

        def new(who: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The pairs not met before, each once."""
            fresh = ~met[who, to]  # noqa: B023
            who, to = who[fresh], to[fresh]
            at = np.arange(len(who))
            slot[who, to] = at  # noqa: B023
            once = slot[who, to] == at  # noqa: B023
            return who[once], to[once]

        who, to = np.repeat(np.arange(m), len(starts)), np.tile(starts, m)
        # what is held of every query, best first: its beam, and all nodes in range whose neighbours weren't looked at
        held, node, value, done = (np.zeros(0, t) for t in (np.int64, np.int64, float, bool))
        last = np.full(m, -np.inf)  # the beam's last
        while len(who):
            met[who, to] = True
            sim = np.einsum("ij,ij->i", part[who], x[to])
            hit = sim >= least
            hits.append((who[hit] + cut, to[hit]))
            good = (sim >= last[who]) | (sim >= far)
            held, node, value = (np.concatenate(v) for v in ((held, who[good]), (node, to[good]), (value, sim[good])))
            done = np.concatenate([done, np.zeros(good.sum(), bool)])
            order = np.lexsort((-value, held))
            held, node, value, done = held[order], node[order], value[order], done[order]
            first = np.searchsorted(held, np.arange(m))
            rank = np.arange(len(held)) - first[held]
            full = rank == BEAM - 1
            last[held[full]] = value[full]
            keep = (rank < BEAM) | ((value >= far) & ~done)
            held, node, value, done, rank = held[keep], node[keep], value[keep], done[keep], rank[keep]
            # the four best that are open, and whatever is in range
            waiting = np.cumsum(~done)
            before = np.concatenate([[0], waiting])[np.searchsorted(held, np.arange(m))]
            go = ~done & ((waiting - before[held] <= 4) | (value >= far))
            done |= go
            who, to = _around(near, held[go], node[go])
            who, to = new(who, to)
            if not len(who) and not done.all():  # neighbours known already, but the beam holds more
                who, to = _around(near, held[~done], node[~done])
                done[:] = True
                who, to = new(who, to)
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a task's links."""
    up: dict[int, int] = {}

    def top(k: int) -> int:
        while up.setdefault(k, k) != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        r, s = top(x), top(y)
        if r != s:
            up[max(r, s)] = min(r, s)
            out.append((x, y))
    return out


def links(cells: DataFrame, near: DataFrame, least: float) -> DataFrame:
    """``(node, n, to)``: link counts (weights of linked nodes, ``to`` null) and spanning edges (``n`` 0) of all tasks."""
    key = ["label", "dim", "cluster"]
    body = cells.join(near, "node", "left")
    packed = body.groupBy(*key, "shard", "shards").agg(*[F.collect_list(F.coalesce(x, F.array().cast("array<long>")) if x == "near" else x).alias(x)
                                                         for x in ("node", "unit", "weight", "clusters", "near")])
    packed = stored(packed)
    left = packed.select(*key, F.col("shard").alias("i"), *[F.col(x).alias(f"a_{x}") for x in ("node", "unit", "weight", "clusters", "near")])
    right = packed.select(*key, F.col("shard").alias("j"), *[F.col(x).alias(f"b_{x}") for x in ("node", "unit", "weight", "clusters", "near")])
    pairs = left.join(right, key).filter("i <= j").repartition("label", "dim", "cluster", "i", "j")

    def side(row: dict, p: str) -> dict:
        ids = np.array(row[f"{p}_node"])
        order = np.argsort(ids)
        x = {"ids": ids[order], "x": _matrix(row[f"{p}_unit"])[order], "w": np.array(row[f"{p}_weight"])[order],
             "clusters": [frozenset(row[f"{p}_clusters"][i]) for i in order]}
        lists = row[f"{p}_near"].values
        to = lists.flatten().to_numpy()
        owner = np.repeat(np.argsort(order), pa.compute.list_value_length(lists).to_numpy())
        at = np.minimum(np.searchsorted(x["ids"], to), len(ids) - 1)
        here = x["ids"][at] == to
        owner, at = owner[here], at[here]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(ids)))])
        return x | {"near": (bounds, at[np.argsort(owner, kind="stable")])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r] if n.endswith("_near") else batch.column(n)[r].as_py() for n in batch.schema.names}
                a = side(row, "a")
                b = a if row["i"] == row["j"] else side(row, "b")
                p, q = _range_search(a["x"], b["x"], b["near"], least)
                if a is not b:
                    q2, p2 = _range_search(b["x"], a["x"], a["near"], least)
                    p, q = np.concatenate([p, p2]), np.concatenate([q, q2])
                else:
                    p, q = np.concatenate([p, q]), np.concatenate([q, p])
                both = np.unique(p * len(b["ids"]) + q)
                p, q = both // len(b["ids"]), both % len(b["ids"])
                own = np.array([min(a["clusters"][i] & b["clusters"][j]) == row["cluster"] for i, j in zip(p.tolist(), q.tolist(), strict=True)], bool)
                own &= a["ids"][p] != b["ids"][q]
                p, q = p[own], q[own]
                n = pd.Series(np.bincount(p, weights=b["w"][q], minlength=len(a["ids"])), index=a["ids"])
                if a is not b:
                    n = pd.concat([n, pd.Series(np.bincount(q, weights=a["w"][p], minlength=len(b["ids"])), index=b["ids"])])
                n = n[n > 0]
                edges = _forest(a["ids"][p], b["ids"][q])
                yield pa.RecordBatch.from_arrays([pa.array([*n.index.tolist(), *(e[0] for e in edges)], pa.int64()),
                                                  pa.array([*n.astype(int).tolist(), *(0 for _ in edges)], pa.int64()),
                                                  pa.array([*(None for _ in range(len(n))), *(e[1] for e in edges)], pa.int64())], names=["node", "n", "to"])

    return stored(pairs.mapInArrow(run, "node long, n long, to long"))


def audit(nodes: DataFrame, counts: DataFrame, least: float) -> tuple[float, int]:
    """(recall, evidence): the share of probes with links that found all of theirs, and how many probes have links, each probe
    compared by brute force with all nodes of its label. Every linked probe counts once, so a clump's many links don't hide a lost
    pair. Probes are a hash sample of ``AUDIT`` nodes, four times as many until ``EVIDENCE`` of them have links or ``PROBES`` are drawn."""
    total, asked = max(nodes.count(), 1), AUDIT
    while True:
        share = asked / total
        draw = F.pmod(F.xxhash64("node", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
        probe = nodes.filter(draw < share).select("node", "label", "unit").collect()  # PROBES at most, about
        groups: dict[tuple[str, int], tuple[list[int], list[bytes]]] = {}
        for r in probe:
            ids, units = groups.setdefault((r["label"], len(r["unit"])), ([], []))
            ids.append(r["node"])
            units.append(bytes(r["unit"]))
        shared = nodes.sparkSession.sparkContext.broadcast({k: (np.array(i), _matrix(u)) for k, (i, u) in groups.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            n: dict[int, int] = {}
            for b in batches:
                node, label, unit, weight = (x.to_pylist() for x in b.columns)
                same: dict[tuple[str, int], list[int]] = {}
                for i, key in enumerate(zip(label, map(len, unit), strict=True)):
                    same.setdefault(key, []).append(i)
                for key, rows in same.items():
                    if key not in shared.value:
                        continue
                    ids, x = shared.value[key]
                    for cut in range(0, len(rows), 1000):
                        part = rows[cut : cut + 1000]
                        own = np.array([node[i] for i in part])
                        near = (x @ _matrix([unit[i] for i in part]).T >= least) & (ids[:, None] != own[None])
                        for k, links in zip(ids.tolist(), (near @ np.array([weight[i] for i in part])).tolist(), strict=True):
                            if links:
                                n[k] = n.get(k, 0) + int(links)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], names=["node", "true"])

        true = nodes.select("node", "label", "unit", "weight").mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
        r = true.join(counts, "node", "left").agg(F.count(F.lit(1)), F.count_if(F.coalesce("n", F.lit(0)) >= F.col("true"))).first()
        if r[0] >= EVIDENCE or asked >= min(total, PROBES):
            return (r[1] / r[0] if r[0] else 0.0), r[0]
        asked *= 4


def near_duplicates(table: DataFrame, least: float = 0.98, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every row."""
    rows, nodes = nodes_of(table, id_col, label_col, vector_col)
    centres, overlap = centres_of(nodes), OVERLAP
    while True:
        cells = clustered(nodes, centres, overlap)
        found = links(cells, graph(cells), least)
        counts = found.filter("to IS NULL").groupBy("node").agg(F.sum("n").alias("n"))
        if overlap >= max(map(len, centres.values()), default=0):
            break
        recall, evidence = audit(nodes, counts, least)
        if (recall >= RECALL and evidence >= EVIDENCE) or (overlap >= SAFE and recall >= RECALL) or (overlap >= SAFE and not evidence):
            break
        overlap *= 2
    label = connected_components(found.filter("to IS NOT NULL").select(F.col("node").alias("a"), F.col("to").alias("b")))
    per = nodes.select("node", "weight").join(counts, "node", "left").join(label, "node", "left")
    per = per.select("node", F.coalesce("label", "node").alias("comp"), (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = rows.join(per, "node", "left").withColumn("comp", F.coalesce("comp", -1 - F.col("row")))  # rows that link with nothing are alone
    first = out.groupBy("comp").agg(F.min("id").alias("component_id"))
    out = out.join(first, "comp")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
