"""Near-duplicate embeddings with hierarchical navigable small-world graphs, one a shard.

Equal vectors are one until the end. Distinct vectors are dealt to shards by a hash; each shard's graph is built in one
task and written. Of every two shards the vectors of one query the graph of the other, and each shard queries itself, so
every vector meets every shard; a link counts for both its ends, which makes the numbers of links symmetric.

Beams are widened until recall audits pass. When a graph is built, queries are planted exactly at the threshold from
known nodes; the first beam that finds all but 1 - AUDIT_RECALL of those nodes is the graph's beam. While blocks of
queries run, a sample of each is checked against the whole shard, and the beam doubles if the links found fall short. A
single query whose beam is more than a quarter links goes on to a wider beam, and at last to the whole shard. Links are
verified by cosine in double precision.

A query gives back its number of links in the shard and one link into each component of the shard that it touches, a graph
the number of links that its nodes got, so what is sent grows with vectors times shards, not with the square of a group of
near copies. Components are joined over all shards.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, rows_a_batch, tidy
from .graph import connected_components

THRESHOLD = 0.95
NEIGHBOURS = 16  # of a node in upper layers; twice as many at the bottom
BUILD_BEAM = 64
BEAM = 32
WIDER = 4  # a full beam goes on to one so many times wider, while that is under 1/LAST of the shard
LAST = 16
PLANTED = 1024
AUDIT_QUERIES = 16  # of a block
AUDIT_RECALL = 0.999
FULL = 0.25  # a beam with a larger share of links may have missed some
#: A shard's vectors and bytes (in doubles) on average at most, and shards at least (for parallel work on small tables).
SHARD_VECTORS = 16_384
SHARD_BYTES = 64 << 20
LEAST_SHARDS = 4
BLOCK = 1024
STEP = 256
BLOCKS_A_TASK = 64
BATCH_ROWS = 16


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in unit length. The largest component is divided out first, so that no square over- or underflows."""
    x = x.astype("f8")
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Graph:
    """Vectors of unit length and, for each layer, the neighbours of its nodes (-1 where there are fewer)."""

    def __init__(self, vectors: np.ndarray):
        self.exact = unit(vectors)
        self.vectors = self.exact.astype("f4")
        n = len(vectors)
        draws = np.random.default_rng(n).random(n)
        self.level = np.minimum((-np.log(np.maximum(draws, 1e-12)) / math.log(NEIGHBOURS)).astype("i8"), 6)
        self.order = np.argsort(-self.level, kind="stable")
        top = int(self.level.max()) if n else 0
        self.layers = [np.full((n, NEIGHBOURS * 2 if k == 0 else NEIGHBOURS), -1, "i4") for k in range(top + 1)]
        self.entry, self.beam = int(self.order[0]) if n else -1, BEAM
        self._build()

    def _build(self) -> None:
        """Nodes come in, highest layers first, in batches that at most double the graph; a batch sees itself too."""
        n, at = len(self.vectors), 1
        while at < n:
            batch = self.order[at : at + min(max(at, 32), 512)]
            inside = self.order[: at + len(batch)]
            near = self.search(self.vectors[batch], BUILD_BEAM)[0]
            for k in range(len(self.layers)):
                rows = np.flatnonzero(self.level[batch] >= k)
                if not len(rows):
                    continue
                nodes = batch[rows]
                mates = self.vectors[nodes] @ self.vectors[nodes].T
                np.fill_diagonal(mates, -2)
                extra = nodes[np.argsort(-mates, axis=1)[:, : min(16, len(nodes) - 1)]]
                found = near[rows] if k == 0 else self._layer_mates(nodes, inside, k)
                found = np.where((found >= 0) & (self.level[np.maximum(found, 0)] >= k), found, -1)
                self._link(nodes, np.concatenate([found, extra], axis=1), k)
            at += len(batch)

    def _layer_mates(self, nodes: np.ndarray, inside: np.ndarray, k: int) -> np.ndarray:
        """Upper layers are small: candidates there are the best of the layer."""
        layer = inside[self.level[inside] >= k]
        out = np.full((len(nodes), BUILD_BEAM), -1)
        for a in range(0, len(nodes), 256):
            close = self.vectors[nodes[a : a + 256]] @ self.vectors[layer].T
            close[layer[None] == nodes[a : a + 256, None]] = -2
            best = np.argsort(-close, axis=1)[:, :BUILD_BEAM]
            out[a : a + 256, : best.shape[1]] = layer[best]
        return out

    def _choose(self, nodes: np.ndarray, found: np.ndarray, most: int) -> np.ndarray:
        """Of the candidates the near ones that are nearer to the node than to any one chosen before; gaps are filled up
        with the nearest of the rest."""
        sims = np.einsum("nd,ncd->nc", self.vectors[nodes], self.vectors[np.maximum(found, 0)])
        sims[(found < 0) | (found == nodes[:, None])] = -3
        order = np.argsort(-sims, axis=1, kind="stable")
        found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
        by_id = np.argsort(found, axis=1, kind="stable")
        sorted_ids = np.take_along_axis(found, by_id, 1)
        again = np.zeros(found.shape, bool)
        np.put_along_axis(again, by_id, np.concatenate([np.zeros((len(found), 1), bool), sorted_ids[:, 1:] == sorted_ids[:, :-1]], axis=1), 1)
        sims[again] = -3
        order = np.argsort(-sims, axis=1, kind="stable")[:, : most * 3]
        found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
        x = self.vectors[np.maximum(found, 0)]
        nearer = np.matmul(x, x.transpose(0, 2, 1)) > sims[:, None, :]  # [i, j]: j is nearer to i than to the node
        chosen, open_ = np.zeros(found.shape, bool), sims > -3
        good = open_.copy()
        for c in range(found.shape[1]):
            chosen[:, c] = open_[:, c]
            open_[:, c + 1 :] &= ~(nearer[:, c, c + 1 :] & open_[:, c : c + 1])
        chosen &= chosen.cumsum(1) <= most
        rank = np.where(chosen, 0, np.where(good, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.full((len(nodes), most), -1, "i4")
        out[:, : order.shape[1]] = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(found, order, 1), -1)
        return out

    def _link(self, nodes: np.ndarray, found: np.ndarray, k: int) -> None:
        layer = self.layers[k]
        most = layer.shape[1]
        layer[nodes] = self._choose(nodes, found, most)
        ends = layer[nodes]
        froms, tos = np.repeat(nodes, most)[ends.ravel() >= 0], ends.ravel()[ends.ravel() >= 0]
        order = np.argsort(tos, kind="stable")
        froms, tos = froms[order], tos[order]
        targets, first, times = np.unique(tos, return_index=True, return_counts=True)
        for a in range(0, len(targets), 512):
            part = slice(a, a + 512)
            wide = int(times[part].max())
            back = np.full((len(targets[part]), wide), -1, "i8")
            place = np.arange(first[part][0], first[part][-1] + times[part][-1])
            back[np.repeat(np.arange(len(targets[part])), times[part]), place - np.repeat(first[part], times[part])] = froms[place]
            layer[targets[part]] = self._choose(targets[part], np.concatenate([layer[targets[part]], back], axis=1), most)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of the best found for each query (unordered, -1 where fewer), STEP queries in step."""
        if len(queries) > STEP:
            parts = [self.search(queries[a : a + STEP], beam) for a in range(0, len(queries), STEP)]
            return tuple(np.concatenate(x) for x in zip(*parts))
        q, rows = len(queries), np.arange(len(queries))
        at = np.full(q, self.entry)
        sim = queries @ self.vectors[self.entry]
        for layer in self.layers[:0:-1]:
            moving = rows
            while len(moving):
                next_ = layer[at[moving]]
                close = np.einsum("qd,qmd->qm", queries[moving], self.vectors[np.maximum(next_, 0)])
                close[next_ < 0] = -3
                best = close.argmax(1)
                value = close[np.arange(len(moving)), best]
                better = value > sim[moving]
                at[moving[better]], sim[moving[better]] = next_[np.arange(len(moving)), best][better], value[better]
                moving = moving[better]
        seen = np.zeros((q, len(self.vectors)), bool)
        seen[rows, at] = True
        nodes, sims, open_ = np.full((q, beam), -1, "i4"), np.full((q, beam), -3, "f4"), np.zeros((q, beam), bool)
        nodes[:, 0], sims[:, 0], open_[:, 0] = at, sim, True
        active, each = rows, 4
        while True:
            active = active[open_[active].any(1)]
            if not len(active):
                return nodes, sims
            s = np.where(open_[active], sims[active], -4)
            best = np.argpartition(-s, min(each, beam - 1), axis=1)[:, :each]
            fine = np.take_along_axis(s, best, 1) > -4
            from_ = np.where(fine, np.take_along_axis(nodes[active], best, 1), -1)
            o = open_[active]
            np.put_along_axis(o, best, False, 1)
            next_ = np.where(from_[:, :, None] >= 0, self.layers[0][np.maximum(from_, 0)], -1).reshape(len(active), -1)
            ordered = np.sort(next_, axis=1)
            ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
            next_ = np.where((ordered >= 0) & ~seen[active[:, None], np.maximum(ordered, 0)], ordered, -1)
            r, c = np.nonzero(next_ >= 0)
            seen[active[r], next_[r, c]] = True
            close = np.full(next_.shape, -3, "f4")
            close[r, c] = np.einsum("qd,qd->q", queries[active[r]], self.vectors[next_[r, c]])
            all_nodes, all_sims = np.concatenate([nodes[active], next_], axis=1), np.concatenate([sims[active], close], axis=1)
            all_open = np.concatenate([o, next_ >= 0], axis=1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            nodes[active], sims[active], open_[active] = (np.take_along_axis(x, keep, 1) for x in (all_nodes, all_sims, all_open))

    def audit(self, threshold: float) -> None:
        """Widen the beam until planted queries, at the threshold from known nodes, find them."""
        n, width = self.exact.shape
        if n <= BEAM or width < 2:
            return
        nodes = np.unique(np.linspace(0, n - 1, min(n, PLANTED)).astype("i8"))
        x = self.exact[nodes]
        away = np.random.default_rng(n).normal(size=x.shape)
        away = unit(away - (away * x).sum(1, keepdims=True) * x)
        cosine = threshold + 1e-3 * (1 - threshold)
        planted = (cosine * x + math.sqrt(1 - cosine * cosine) * away).astype("f4")
        while self.beam < n:
            found, sims = self.search(planted, self.beam)
            fair = (sims >= threshold - 1e-4).sum(1) <= self.beam * FULL  # others go to wider beams in any case
            if (found[fair] == nodes[fair, None]).any(1).sum() >= AUDIT_RECALL * fair.sum():
                return
            self.beam *= 2

    def by_beams(self, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries and nodes with cosine >= threshold, and the queries for which the whole shard must be read.
        queries have unit length, in double precision."""
        loose, n, single = threshold - 1e-4, len(self.vectors), queries.astype("f4")
        sample = np.unique(np.linspace(0, len(queries) - 1, min(len(queries), AUDIT_QUERIES)).astype("i8"))
        true = single[sample] @ self.vectors.T >= loose
        while True:
            left, found, hits, there, width = np.arange(len(queries)), [(np.zeros(0, "i8"), np.zeros(0, "i8"))], 0, 0, self.beam
            while len(left) and width * (1 if width == self.beam else LAST) < n:
                nodes, sims = self.search(single[left], width)
                hit = (sims >= loose) & (nodes >= 0)
                full = hit.sum(1) > width * FULL
                tested = np.flatnonzero(np.isin(left, sample) & ~full)
                hits, there = hits + hit[tested].sum(), there + true[np.searchsorted(sample, left[tested])].sum()
                r, c = np.nonzero(hit & ~full[:, None])
                found.append((left[r], nodes[r, c].astype("i8")))
                left, width = left[full], width * WIDER
            if hits >= AUDIT_RECALL * there:
                query, node = (np.concatenate(x) for x in zip(*found))
                return *self._verified(queries, query, node, threshold), left
            self.beam *= 2  # the audit fails: wider beams from here on

    def by_reading(self, queries: np.ndarray, left: np.ndarray, threshold: float):
        """The same for the queries left, from the whole shard, a few queries at a time."""
        for a in range(0, len(left), 256):
            r, node = np.nonzero(queries[left[a : a + 256]].astype("f4") @ self.vectors.T >= threshold - 1e-4)
            yield self._verified(queries, left[a : a + 256][r], node, threshold)

    def near(self, queries: np.ndarray, threshold: float):
        """All pairs, piece by piece."""
        query, node, left = self.by_beams(queries, threshold)
        yield query, node
        yield from self.by_reading(queries, left, threshold)

    def _verified(self, queries: np.ndarray, query: np.ndarray, node: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        good = np.zeros(len(query), bool)
        for a in range(0, len(query), 1 << 16):
            part = slice(a, a + (1 << 16))
            good[part] = np.einsum("nd,nd->n", queries[query[part]], self.exact[node[part]]) >= threshold
        return query[good], node[good]

    def own_links(self, threshold: float, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node its number of links within the shard, copies (times) counted, and the least node they reach.

        Nodes whose links were found by beams give pairs, which are few; a pair counts for both ends though only one found
        it. Nodes for which the whole shard was read count for themselves and give pairs with the others only."""
        n = len(self.vectors)
        counts, root, whole = np.zeros(n, "i8"), np.arange(n), np.zeros(n, bool)
        pairs, rest = [np.zeros((0, 2), "i8")], [np.zeros(0, "i8")]
        for a in range(0, n, BLOCK):
            query, node, left = self.by_beams(self.exact[a : a + BLOCK], threshold)
            pairs.append(np.stack([query + a, node], axis=1))
            rest.append(left + a)
        rest = np.concatenate(rest)
        whole[rest] = True
        for query, node in self.by_reading(self.exact, rest, threshold):
            query, node = query[query != node], node[query != node]
            both = whole[node]
            counts += np.bincount(query[both], times[node[both]], n).astype("i8")
            pairs.append(np.stack([query[~both], node[~both]], axis=1))
            _join(root, query, node)
        x = np.sort(np.concatenate(pairs), axis=1)
        x = np.unique(x[x[:, 0] < x[:, 1]], axis=0)
        counts += np.bincount(x[:, 0], times[x[:, 1]], n).astype("i8") + np.bincount(x[:, 1], times[x[:, 0]], n).astype("i8")
        _join(root, x[:, 0], x[:, 1])
        return counts, root

    def pack(self) -> list[bytes]:
        return [x.tobytes() for x in self.layers]

    @classmethod
    def unpack(cls, vectors: np.ndarray, layers: list[bytes], entry: int, beam: int) -> "Graph":
        self = cls.__new__(cls)
        self.exact, self.entry, self.beam = unit(vectors), entry, beam
        self.vectors = self.exact.astype("f4")
        self.layers = [np.frombuffer(x, "i4").reshape(len(vectors), -1) for x in layers]
        return self


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of each pair; roots are the least nodes."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def usable(column: str = "embedding"):
    """Not null, no component null or not finite, and not all zero."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(column).isNotNull() & fine & F.exists(column, lambda x: x != 0)


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """vectors: vec_id, embedding. Returns written tables (copies, found): copies has vec_id, first, times for each usable
    vector; found has first, n_links (of other distinct vectors, counted with their copies; to be summed) and ends (a link
    into each component it touches).

    Vectors travel as they are stored, in 32 bits where the column is one of floats. Shards are as many as vectors and bytes
    ask for; a graph is sent once for every BLOCKS_A_TASK blocks that query it, a block to half of the shards."""
    spark = vectors.sparkSession
    kind = "f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "f8"
    good = vectors.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{'float' if kind == 'f4' else 'double'}>").alias("embedding")
    ).where(F.col("vec_id").isNotNull() & usable())
    keyed = good.withColumn("key", F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: (x.cast("double") + F.lit(0.0)).cast("string"))), 256))
    with Scratch(spark) as tables:
        firsts = tables.cut(
            keyed.groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("times"), F.first("embedding").alias("embedding")), "vectors"
        )
        copies = keyed.select("vec_id", "key").join(
            firsts.select(F.col("key").alias("k"), "first", "times"), F.col("key") == F.col("k")
        ).select("vec_id", "first", "times")
        copies = cut(copies, "copies")

        widths = firsts.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).collect()  # one row a width
        dealt = {r.width: shards or max(LEAST_SHARDS, -(-r.n // max(1, min(SHARD_VECTORS, SHARD_BYTES // (8 * r.width))))) for r in widths}
        # of the blocks about half query a graph
        salts = {
            r.width: max(
                -(-r.n // (2 * BLOCK * BLOCKS_A_TASK)), min(-(-r.n // (2 * BLOCK)), -(-spark.sparkContext.defaultParallelism // dealt[r.width]))
            ) for r in widths
        }

        def by_width(numbers: dict):
            return F.coalesce(*[F.when(F.col("width") == w, F.lit(x)) for w, x in numbers.items()]) if numbers else F.lit(1)

        rows = firsts.select("first", "times", "embedding", F.size("embedding").alias("width"))
        rows = rows.withColumn("shard", F.pmod(F.xxhash64("first"), by_width(dealt)).cast("int"))

        def build(table: pa.Table) -> pa.Table:
            width, shard = table["width"][0].as_py(), table["shard"][0].as_py()
            table = table.sort_by("first")
            stored = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            first, times = table["first"].to_numpy(), table["times"].to_numpy()
            graph = Graph(stored)
            graph.audit(threshold)
            counts, root = graph.own_links(threshold, times)
            blocks = [slice(a, a + BLOCK) for a in range(0, len(first), BLOCK)]
            columns = [
                [width], [shard], [graph.entry], [graph.beam], [[first[b].tobytes() for b in blocks]], [[times[b].tobytes() for b in blocks]],
                [[stored[b].tobytes() for b in blocks]], [counts.tobytes()], [first[root].tobytes()], [graph.pack()]
            ]
            kinds = [pa.int32()] * 4 + [pa.list_(pa.binary())] * 3 + [pa.binary()] * 2 + [pa.list_(pa.binary())]
            return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], GRAPH)

        with rows_a_batch(spark, BATCH_ROWS * BLOCK):
            graphs = tables.cut(
                rows.select("width", "shard", "first", "times", "embedding").groupBy("width", "shard").applyInArrow(build, SCHEMA), "graphs",
                maxRecordsPerFile=1
            )

        blocks = graphs.select("width", F.col("shard").alias("of"), F.posexplode(F.arrays_zip("ids", "times", "data")).alias("place", "b"))
        asked = F.filter(F.sequence(F.lit(0), by_width(dealt) - 1), lambda s: (s != F.col("of")) & ((F.col("of") < s) == ((F.col("of") + s) % 2 == 0)))
        salt = F.pmod(F.xxhash64("of", "place"), by_width(salts)).cast("int")
        none = F.lit(None)
        asks = blocks.select(
            "width", F.explode(asked).alias("shard"), none.cast("int").alias("entry"), none.cast("int").alias("beam"),
            *[F.array(f"b.{c}").alias(c) for c in ("ids", "times", "data")], none.cast("binary").alias("counts"), none.cast("binary").alias("roots"),
            none.cast("array<binary>").alias("layers"), salt.alias("salt"), F.lit(1).alias("kind")
        )
        sent = graphs.select("*", F.explode(F.sequence(F.lit(0), by_width(salts) - 1)).alias("salt"), F.lit(0).alias("kind"))
        met = sent.unionByName(asks).repartition("width", "shard", "salt").sortWithinPartitions("width", "shard", "salt", "kind")

        def ask(batches):
            graph = ids = times = roots = got = at = None
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)}
                    own, copies_ = (np.frombuffer(b"".join(row[c]), "i8") for c in ("ids", "times"))
                    x = np.frombuffer(b"".join(row["data"]), kind).reshape(len(own), row["width"])
                    if row["kind"] == 0:
                        if graph is not None:
                            yield _links(ids, got)
                        at = row["width"], row["shard"], row["salt"]
                        graph, ids, times = Graph.unpack(x, row["layers"], row["entry"], row["beam"]), own, copies_
                        roots, got = np.frombuffer(row["roots"], "i8"), np.zeros(len(own), "i8")
                        if row["salt"] == 0:
                            yield _links(ids, np.frombuffer(row["counts"], "i8"), np.stack([np.arange(len(ids)), roots], axis=1))
                        continue
                    if at != (row["width"], row["shard"], row["salt"]):  # a shard without vectors
                        continue
                    count, ends = np.zeros(len(own), "i8"), [np.zeros((0, 2), "i8")]
                    for query, node in graph.near(unit(x), threshold):
                        count += np.bincount(query, times[node], len(own)).astype("i8")
                        got += np.bincount(node, copies_[query], len(ids)).astype("i8")
                        ends.append(np.unique(np.stack([query, roots[node]], axis=1), axis=0))
                    yield _links(own, count, np.unique(np.concatenate(ends), axis=0))
            if graph is not None:
                yield _links(ids, got)

        with rows_a_batch(spark, BATCH_ROWS):
            return copies, cut(met.select(*GRAPH, "salt", "kind").mapInArrow(tidy(ask), "first long, n_links long, ends array<long>"), "found")


GRAPH = ["width", "shard", "entry", "beam", "ids", "times", "data", "counts", "roots", "layers"]
SCHEMA = "width int, shard int, entry int, beam int, ids array<binary>, times array<binary>, data array<binary>, counts binary, roots binary, layers array<binary>"


def _links(ids: np.ndarray, counts: np.ndarray, ends: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each id with links; ends are pairs (place, end) in order."""
    hit = np.flatnonzero(counts)
    if ends is None:
        ends = np.zeros((0, 2), "i8")
    ends = ends[np.isin(ends[:, 0], hit)]
    offsets = np.append(np.searchsorted(ends[:, 0], hit), len(ends)).astype("i4")
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(ends[:, 1])))
    return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(counts[hit]), lists], ["first", "n_links", "ends"])


def near_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, shards: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, and so do vectors of different
    lengths and rows without an id (whose component is null; they are kept). Rows of equal vectors link with each other.
    Components may be as large or small as their type holds. An empty table gives an empty table.
    """
    copies, found = embedding_links(vectors, threshold, shards)
    inside = copies.where("first <> vec_id").select(F.col("first").alias("a"), F.col("vec_id").alias("b"))
    across = found.select(F.col("first").alias("a"), F.explode("ends").alias("b"))
    components = connected_components(inside.unionByName(across))
    counts = found.groupBy(F.col("first").alias("f")).agg(F.sum("n_links").alias("links"))
    of_copies = copies.groupBy("vec_id", "first", "times").agg(F.count("*").alias("rows"))
    linked = of_copies.join(counts, F.col("first") == F.col("f"), "left").select(
        F.col("vec_id").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links")
    )
    linked = linked.groupBy("v").agg(F.max("links").alias("links"))
    out = vectors.select("vec_id").join(linked, F.col("vec_id") == F.col("v"), "left").join(components, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )
