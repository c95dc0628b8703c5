"""Embedding near-dedup over an inverted multi-index.

Each half of a vector has its own codebook; the two together form a product grid of cells. Every row is indexed in the
cell of its nearest codewords. A query visits the cells by a multi-sequence traversal: the two lists of half distances,
each sorted, are merged by a heap in order of their sum, until the target recall is reached; what is found there is
verified in double precision. Distances to a cell are lower bounds of the distance to its Voronoi region.

The stop is measured: RECALL_QUERIES vectors, drawn by hash, are compared with all vectors, and the distance is taken up
to which the traversal finds `target_recall` of their links, both on the mean over these vectors and over all their
links together. With target_recall 1 it is the bound beyond which no cell can hold a neighbour, so nothing is lost.

Equal vectors of a label are one class with a count. A pair of classes is looked for from the one whose cell comes first
only. Cells are held in blocks of classes; a block of queries meets a block of members in one matrix product. A block
pair gives a count per class and a spanning forest of its links, never the links one by one, so a group of near copies
costs no rows of its square.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components link with nothing, and so do
those with a null label or vec_id (a null vec_id has no component and is kept); vectors of another length than the most
frequent one share one cell per length and label. Each row is a vector of its own: rows that share a vec_id each give a
row with the count of their own links, and have one component. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import Forest, components
from .common import blocks, table, with_totals, with_values, without

#: Rows of a block.
BLOCK = 256
#: Rows the codebooks are fitted on, for each codeword.
FIT_ROWS_PER_WORD, MAX_WORDS, MIN_WORDS = 64, 256, 8
#: Vectors whose links are all looked up to measure the stop, and steps in which it is measured.
RECALL_QUERIES, STEPS = 2048, 100


def _unit(vector) -> np.ndarray | None:
    if vector is None or not len(vector):
        return None
    try:
        x = np.array(vector, np.float64)
    except TypeError:
        return None
    if not np.isfinite(x).all() or not (top := np.abs(x).max()) > 0:
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def _lloyd(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k codewords of the rows of x (fewer where there are fewer distinct rows)."""
    words = np.unique(x, axis=0)
    words = words[np.random.default_rng(7).permutation(len(words))[:k]]
    for _ in range(rounds):
        near = _squares(x, words).argmin(1)
        words = np.array([x[near == i].mean(0) if (near == i).any() else words[i] for i in range(len(words))])
    return words


def _squares(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (words * words).sum(1)[None, :] - 2 * x @ words.T, 0)


def _reach(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each row; lower bounds of the squared distance to each codeword's region."""
    d = _squares(x, words)
    apart = np.sqrt(_squares(words, words))
    np.fill_diagonal(apart, np.inf)
    low = np.zeros_like(d)
    for k in range(len(words)):
        low = np.maximum(low, (d - d[:, k : k + 1]) / np.maximum(2 * apart[k], 1e-12))
    return d.argmin(1), np.maximum(low - 1e-9, 0) ** 2


def visited(left: np.ndarray, right: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Multi-sequence traversal: cells (i, j) in ascending order of left[i] + right[j], up to limit."""
    a, b = np.argsort(left, kind="stable").tolist(), np.argsort(right, kind="stable").tolist()
    heap, found = [(left[a[0]] + right[b[0]], 0, 0)], []
    while heap:
        d, i, j = heapq.heappop(heap)
        if d > limit:
            break
        found.append((a[i], b[j]))
        if j + 1 < len(b):
            heapq.heappush(heap, (left[a[i]] + right[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (left[a[i + 1]] + right[b[0]], i + 1, 0))
    return found


class Grid:
    """Codebooks of the two halves, and the squared distance up to which cells are visited."""

    def __init__(self, sample: np.ndarray, threshold: float, words: int):
        self.length, self.half = sample.shape[1], sample.shape[1] // 2
        self.books = [_lloyd(sample[:, : self.half], words), _lloyd(sample[:, self.half :], words)]
        self.width = len(self.books[1])
        # no neighbour lies in a cell farther than this
        self.limit = self.bound = 2 * (1 - threshold) + 1e-9

    def reach(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each row; lower bounds of the squared distances to the halves of the cells."""
        (i, left), (j, right) = _reach(x[:, : self.half], self.books[0]), _reach(x[:, self.half :], self.books[1])
        return i * self.width + j, left, right

    def place(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """The cell of each row, and the cells from its own on that it visits."""
        own, left, right = self.reach(x)
        found = []
        for near, far, cell in zip(left, right, own.tolist(), strict=True):
            cells = {a * self.width + b for a, b in visited(near, far, self.limit)}
            found.append(sorted({c for c in cells if c >= cell} | {cell}))
        return own, found


def _decode(data: Iterable[bytes], kind: str) -> np.ndarray:
    """Packed vectors of one length as unit vectors in double precision."""
    x = np.stack([np.frombuffer(v, kind) for v in data]).astype(np.float64)
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _valid(kind: str):
    """Rows with the bytes of their vector where it can link with others."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [_unit(v) is not None for v in batch["embedding"]]
            part = batch[good]
            vectors = [np.asarray(v, kind).tobytes() for v in part["embedding"]]
            yield part[["row", "label"]].assign(length=[len(v) // np.dtype(kind).itemsize for v in vectors], vector=vectors)

    return run


def _measured(grid: Grid, kind: str, queries: list[tuple[int, str, bytes]], threshold: float):
    """Per query and step of the distance: how many of its links the traversal finds there first."""
    marks = np.array([row for row, *_ in queries])
    labels = np.array([label for _, label, _ in queries], object)
    asked = _decode([v for *_, v in queries], kind)
    cells, near, far = grid.reach(asked)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["length"] == grid.length]
            if not len(batch):
                continue
            x = _decode(batch["vector"], kind)
            own, left, right = grid.reach(x)
            linked = (x @ asked.T >= threshold) & (batch["label"].to_numpy(object)[:, None] == labels[None, :])
            i, q = np.nonzero(linked & (batch["row"].to_numpy()[:, None] != marks[None, :]))
            # the one whose cell comes first visits the other's
            to, of = divmod(cells[q], grid.width), divmod(own[i], grid.width)
            reach = np.where(own[i] <= cells[q], left[i, to[0]] + right[i, to[1]], near[q, of[0]] + far[q, of[1]])
            reach = np.where(own[i] == cells[q], 0, reach)
            step = np.minimum(np.ceil(reach / grid.bound * STEPS), STEPS).astype(int)
            yield pd.DataFrame({"query": q, "step": step, "n": batch["n"].to_numpy()[i]}).groupby(["query", "step"], as_index=False).sum()

    return run


def stop(counts: dict[int, np.ndarray], target_recall: float) -> float:
    """The share of the bound up to which cells are visited, for counts of links per query and step; 1 without links."""
    if not counts:
        return 1.0
    found = np.cumsum(list(counts.values()), 1).astype(float)
    recall = np.minimum((found / found[:, -1:]).mean(0), found.sum(0) / found[:, -1].sum())
    return int(np.argmax(recall >= target_recall)) / STEPS


def _placed(grid: Grid | None, kind: str):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, cells = np.full(len(batch), -1), [[-1]] * len(batch)
            usual = np.flatnonzero(batch["length"].to_numpy() == grid.length) if grid is not None else []
            if len(usual):
                own, lists = grid.place(_decode(batch["vector"].iloc[usual], kind))
                cell[usual] = own
                for k, visits in zip(usual, lists, strict=True):
                    cells[k] = visits
            yield batch.assign(cell=cell, cells=cells)

    return run


def _packed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in blocks(batches, ["label", "length", "at"], BLOCK):
        packed = {c: [x[c].to_numpy("<i8").tobytes()] for c in ("row", "node", "n", "cell")}
        yield pd.DataFrame({c: [x[c].iloc[0]] for c in ("label", "length", "at")} | packed | {"vectors": [b"".join(x["vector"])]})


def _links(threshold: float, kind: str):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = lambda data: np.frombuffer(data, "<i8")
        for batch in batches:
            for x in batch.itertuples():
                row, found = numbers(x.row), numbers(x.row2)
                size = x.length * np.dtype(kind).itemsize
                left, right = (_decode([v[i : i + size] for i in range(0, len(v), size)], kind) for v in (x.vectors, x.vectors2))
                own = numbers(x.cell) == x.at
                linked = (left @ right.T >= threshold) & (~own[:, None] | (row[:, None] < found[None, :]))
                i, j = np.nonzero(linked)
                if not len(i):
                    continue
                tree, node, node2 = Forest(), numbers(x.node), numbers(x.node2)
                for a, b in np.unique(np.stack([node[i], node2[j]], 1), axis=0).tolist():
                    tree.join(a, b)
                who = np.concatenate([row, found])
                n = np.concatenate([linked @ numbers(x.n2), numbers(x.n) @ linked])
                yield pd.DataFrame({"a": who, "b": pd.array([None] * len(who), "Int64"), "n": n})[n > 0]
                yield tree.edges().assign(n=0).astype({"b": "Int64"})

    return run


def _grid(classes: DataFrame, kind: str, threshold: float, target_recall: float) -> Grid | None:
    """Codebooks fitted on at most FIT_ROWS_PER_WORD * MAX_WORDS vectors, with the measured stop."""
    usual = classes.groupBy("length").agg(F.count("*").alias("n")).where("length > 1").orderBy(F.desc("n"), "length").first()
    if usual is None:
        return None
    words = int(min(MAX_WORDS, max(MIN_WORDS, (usual["n"] / 500) ** 0.5)))
    some = classes.where(F.col("length") == usual["length"]).orderBy(F.xxhash64("row"), "row")
    sample = some.limit(FIT_ROWS_PER_WORD * words).select("row", "label", "vector").collect()
    grid = Grid(_decode([r["vector"] for r in sample], kind), threshold, words)
    if target_recall < 1:
        queries = [(r["row"], r["label"], bytes(r["vector"])) for r in sample[:RECALL_QUERIES]]
        found = classes.mapInPandas(_measured(grid, kind, queries, threshold), "query int, step int, n long")
        counts: dict[int, np.ndarray] = {}
        # at most RECALL_QUERIES * (STEPS + 1) rows
        for r in found.groupBy("query", "step").agg(F.sum("n").alias("n")).collect():
            counts.setdefault(r["query"], np.zeros(STEPS + 1))[r["step"]] = r["n"]
        grid.limit = grid.bound * stop(counts, target_recall)
    return grid


def near_vectors(vectors: DataFrame, threshold: float = 0.93, target_recall: float = 0.995) -> DataFrame:
    """One row per row of (vec_id, embedding, label, ...): vec_id, n_links, component_id, kept."""
    rows = without(vectors, "vec_id", "embedding", "label")
    kind = "<f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    rows = table(rows.withColumn("row", F.monotonically_increasing_id()))
    # two 64-bit hashes of a label and vector stand for both
    digest = [F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(1), "label", "embedding").alias("h2")]
    can_link = rows.where("vec_id is not null and label is not null and embedding is not null")
    totals = {"of": (F.min("row"), F.min), "node": (F.min("vec_id"), F.min), "n": (F.count("*"), F.sum)}
    member = table(with_totals(can_link.select("row", "vec_id", *digest), ["h1", "h2"], "row", totals).drop("h1", "h2"))
    valid = rows.select("row", "label", "embedding").mapInPandas(_valid(kind), "row long, label string, length int, vector binary")
    classes = table(valid.join(member.where("row = of").select("row", "node", "n"), "row"))
    grid = _grid(classes, kind, threshold, target_recall)
    shape = "row long, label string, length int, vector binary, node long, n long, cell long, cells array<long>"
    placed = table(classes.mapInPandas(_placed(grid, kind), shape))
    names = ["row", "node", "n", "cell", "vectors"]
    packed = "label string, length int, at long, row binary, node binary, n binary, cell binary, vectors binary"
    keys = ["label", "length", "at"]

    def pack(df: DataFrame) -> DataFrame:
        df = df.select(*keys, "row", "node", "n", "cell", "vector").repartitionByRange(*keys, "row")
        return df.sortWithinPartitions(*keys, "row").mapInPandas(_packed, packed)

    members = pack(placed.withColumn("at", F.col("cell"))).select(*keys, *[F.col(c).alias(c + "2") for c in names if c != "cell"])
    queries = pack(placed.withColumn("at", F.explode("cells")))
    links = table(queries.join(members, keys).mapInPandas(_links(threshold, kind), "a long, b long, n long"))
    counts = links.where("b is null").groupBy(F.col("a").alias("of")).agg(F.sum("n").alias("linked"))
    # a vec_id with several vectors joins their classes
    linking = member.join(classes.select(F.col("row").alias("of")), "of", "left_semi")
    many = linking.groupBy("vec_id").agg(F.min("node").alias("b"), F.max("node").alias("high")).where("b < high").select("vec_id", "b")
    own = linking.join(many, "vec_id").where("node <> b").select(F.col("node").alias("a"), "b")
    joined = components(links.where("b is not null").select("a", "b").union(own))
    known = classes.select(F.col("row").alias("of"), "node", "n").join(counts, "of", "left").join(joined, F.col("node") == F.col("id"), "left")
    known = known.select("of", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "node").alias("component"))
    found = with_values(member.select("row", "of"), "of", "row", known).select("row", "n_links", "component")
    out = rows.select("row", "vec_id").join(found, "row", "left")
    # rows that can't link may share a vec_id with others
    of_id = linking.select("vec_id", "node").distinct().join(joined, F.col("node") == F.col("id"), "left")
    of_id = of_id.groupBy("vec_id").agg(F.min(F.coalesce("component_id", "node")).alias("other"))
    lone = out.where("component is null").join(of_id, "vec_id", "left").select("vec_id", "n_links", "component", "other")
    out = out.where("component is not null").select("vec_id", "n_links", "component", F.lit(None).cast("long").alias("other")).union(lone)
    component = F.coalesce("component", "other", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
