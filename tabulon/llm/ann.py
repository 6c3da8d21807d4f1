"""Operator 7, approximate nearest neighbours: score-aware anisotropic quantisation.

The nearest vector x to q has the largest q.x - |x|^2 / 2, a maximum inner product. The codes
approximate q.x; |x| is kept as it is. Codebooks (16 entries, so four bits, for each pair of dimensions)
are fitted to a bounded sample under the anisotropic loss, which weighs the residual's part parallel to
the vector more than the orthogonal part. Queries scan the codes with eight-bit tables; the best
`rerank` of each block of rows are compared exactly and give a radius. A row is nowhere nearer than its
code's distance less its residual's norm and the tables' rounding; every row of the block for which that
is within the radius is compared exactly too, in double precision, so no neighbour is lost.

Every row is indexed: coded once and written into the cell of its nearest coarse centre. A query is first compared with its
own cell; that bounds how far its neighbours can be, and of the other cells only those that reach into that radius (their
centre's distance less the farthest member's) are scanned. So where vectors have structure most cells are left out, and
where they have none all are compared; recall is 1 either way. Of equal vectors only the k + 1 smallest ids are scanned, which
loses no result. Cells and the queries that need them are dealt into blocks of bounded size, and each pair of blocks is one group.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
those whose dimension is not the most frequent (of ties the smallest), nor rows without vec_id; of rows that
repeat a query's vec_id the smallest vector asks; ties go to the smaller vec_id; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.sources.shared import written

ENTRIES = 16


@dataclass(frozen=True)
class Codebooks:
    """centres[part, entry, dimension in the part]; the last part may be padded with zeros."""

    dimension: int
    centres: np.ndarray

    def split(self, x: np.ndarray) -> np.ndarray:
        parts, _, width = self.centres.shape
        out = np.zeros((len(x), parts * width), x.dtype)
        out[:, : self.dimension] = x
        return out.reshape(len(x), parts, width)


def encode(x: np.ndarray, books: Codebooks, weight: float, rounds: int = 2) -> np.ndarray:
    """Codes (uint8, below 16) by coordinate descent on |r|^2 + weight (r.x / |x|)^2 for the residual r."""
    parts = books.split(x.astype(np.float64))
    centres = books.centres.astype(np.float64)
    unit = parts / np.maximum(np.sqrt((parts**2).sum(axis=(1, 2), keepdims=True)), 1e-12)
    plain = np.stack([((parts[:, p, None] - centres[p]) ** 2).sum(axis=2) for p in range(len(centres))], axis=1)
    along = np.stack([((parts[:, p, None] - centres[p]) * unit[:, p, None]).sum(axis=2) for p in range(len(centres))], axis=1)
    codes = plain.argmin(axis=2)
    rows = np.arange(len(x))
    total = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0].sum(axis=1)
    for _ in range(rounds):
        for p in range(len(centres)):
            rest = total - along[rows, p, codes[:, p]]
            codes[:, p] = (plain[:, p] + weight * (rest[:, None] + along[:, p]) ** 2).argmin(axis=1)
            total = rest + along[rows, p, codes[:, p]]
    return codes.astype(np.uint8)


def fitted(sample: np.ndarray, width: int = 2, threshold: float = 0.2, rounds: int = 6, seed: int = 7) -> tuple[Codebooks, float]:
    """(codebooks, weight of the parallel error). threshold: the cosine from which scores matter."""
    n, dimension = sample.shape
    parts = -(-dimension // width)
    weight = max(0.0, (dimension - 1) * threshold**2 / (1 - threshold**2) - 1)
    draw = np.random.default_rng(seed)
    books = Codebooks(dimension, np.zeros((parts, ENTRIES, width)))
    x = books.split(sample.astype(np.float64))
    books.centres[:] = np.stack([x[draw.choice(n, ENTRIES, replace=n < ENTRIES), p] for p in range(parts)])
    for _ in range(rounds):  # plain k-means first
        for p in range(parts):
            own = ((x[:, p, None] - books.centres[p]) ** 2).sum(axis=2).argmin(axis=1)
            for e in np.unique(own):
                books.centres[p, e] = x[own == e, p].mean(axis=0)
    unit = x / np.maximum(np.sqrt((x**2).sum(axis=(1, 2), keepdims=True)), 1e-12)
    for _ in range(rounds):  # then the anisotropic loss: codes, and a linear system for each centre
        codes = encode(sample, books, weight, 1)
        for p in range(parts):
            chosen = np.stack([books.centres[q][codes[:, q]] for q in range(parts)], axis=1)
            rest = ((x - chosen) * unit).sum(axis=(1, 2)) - ((x[:, p] - chosen[:, p]) * unit[:, p]).sum(axis=1)
            for e in np.unique(codes[:, p]):
                m = codes[:, p] == e
                u, v = unit[m, p], x[m, p]
                left = m.sum() * np.eye(width) + weight * u.T @ u
                right = v.sum(axis=0) + weight * (u * ((u * v).sum(axis=1) + rest[m])[:, None]).sum(axis=0)
                books.centres[p, e] = np.linalg.solve(left, right)
    return Codebooks(dimension, books.centres.astype(np.float32)), weight


def decode(codes: np.ndarray, books: Codebooks) -> np.ndarray:
    """The vectors that codes stand for."""
    parts = books.centres.astype(np.float64)[np.arange(codes.shape[1]), codes]
    return parts.reshape(len(codes), -1)[:, : books.dimension]


def scanned(queries: np.ndarray, codes: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """(approximate q.x (queries x rows) from eight-bit tables of four-bit codes, how far each query's are from q.decode(codes) at most)."""
    parts = books.split(queries.astype(np.float64))
    tables = np.einsum("qpw,pew->qpe", parts, books.centres.astype(np.float64))
    low = tables.min(axis=2, keepdims=True)
    step = np.maximum((tables - low).max(axis=(1, 2)), 1e-12) / 255
    small = np.rint((tables - low) / step[:, None, None]).astype(np.uint16)
    sums = np.zeros((len(queries), len(codes)), np.uint16 if codes.shape[1] <= 256 else np.uint32)
    for p in range(codes.shape[1]):
        sums += np.take(small[:, p], codes[:, p], axis=1)
    return sums * step[:, None] + low.sum(axis=(1, 2))[:, None], step * codes.shape[1] / 2


def leading(scores: np.ndarray, count: int) -> np.ndarray:
    """The places of the count largest, of equal ones the first."""
    if len(scores) <= count:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - count)[len(scores) - count]
    over = np.flatnonzero(scores > edge)
    return np.concatenate((over, np.flatnonzero(scores == edge)[: count - len(over)]))


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to centres, in double precision."""
    out = np.empty((len(x), len(centres)))
    for at in range(0, len(x), 512):
        part = x[at : at + 512].astype(np.float64)
        squares = (part**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None] - 2 * part @ centres.T
        out[at : at + 512] = np.sqrt(np.maximum(squares, 0))
    return out


def coarse(sample: np.ndarray, count: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Centres of cells, by k-means over the sample."""
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:count]].astype(np.float64)
    for _ in range(rounds):
        own = distances(sample, centres).argmin(axis=1)
        for c in np.unique(own):
            centres[c] = sample[own == c].mean(axis=0)
    return centres


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, sample: int = 8000, block_rows: int = 8192, block_queries: int = 8192, rerank: int = 100, cells: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose vec_id is divisible by every."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "array<double>" if kind not in ("float", "tinyint", "smallint") else "array<float>"  # exact in either case
    ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()
    sound = ok & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).filter(F.coalesce(sound, F.lit(False)))
    sizes = clean.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, vec_id long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    clean = clean.filter(F.size("embedding") == sizes["d"])
    chance = min(1.0, sample / sizes["n"])
    learn = clean.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < chance * (1 << 20)).orderBy("vec_id").limit(2 * sample).collect()
    if not learn:
        learn = clean.limit(sample).collect()
    books, weight = fitted(np.array([r["embedding"] for r in learn], np.float32))
    shared = vectors.sparkSession.sparkContext.broadcast((books, weight))
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    rows = clean.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy")
    centres = coarse(np.array([r["embedding"] for r in learn], np.float32), min(cells, max(1, -(-sizes["n"] // block_rows))))
    places = vectors.sparkSession.sparkContext.broadcast(centres)

    def coded(frames):
        books, weight = shared.value
        for frame in frames:
            x = np.stack(frame["embedding"].to_numpy()) if len(frame) else np.zeros((0, books.dimension), np.float32)
            away = distances(x, places.value)
            cell = away.argmin(axis=1)
            codes = [c.tobytes() for c in encode(x, books, weight)] if len(x) else []
            yield frame.assign(cell=cell.astype(np.int32), away=away[np.arange(len(x)), cell], codes=codes)

    kept = written(rows.mapInPandas(coded, f"vec_id long, embedding {kind}, cell int, away double, codes binary"), "codes")
    facts = {r["cell"]: (r["n"], r["far"]) for r in kept.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("far")).collect()}  # at most `cells` rows
    reach = np.array([facts.get(c, (0, -1.0))[1] for c in range(len(centres))])
    blocks = {c: -(-n // block_rows) for c, (n, _) in facts.items()}
    asked = written(clean.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")

    def needing(frames, first: bool):
        """The cells that each query needs: its own, or those others that reach into its radius."""
        for frame in frames:
            x = np.stack(frame["embedding"].to_numpy()) if len(frame) else np.zeros((0, centres.shape[1]), np.float32)
            away = np.where(reach[None] < 0, np.inf, distances(x, places.value))
            own = away.argmin(axis=1)
            if first:
                need = np.zeros(away.shape, bool)
                need[np.arange(len(x)), own] = True
            else:
                need = (away - reach[None] <= frame["radius"].to_numpy()[:, None] + 1e-6 * (1 + np.where(np.isfinite(away), away, 0.0) + reach[None])) & np.isfinite(away)
                need[np.arange(len(x)), own] = False
            i, c = np.nonzero(need)
            radius = np.full(len(i), np.inf) if first else frame["radius"].to_numpy()[i]
            yield pd.DataFrame({"vec_id": frame["vec_id"].to_numpy()[i], "embedding": frame["embedding"].to_numpy()[i], "radius": radius, "cell": c.astype(np.int32)})

    def compared(queries: DataFrame) -> DataFrame:
        """query_id, vec_id, score of the k nearest in each block of rows of the cells that queries (vec_id, embedding, radius, cell) name."""
        queries = written(queries, "asked")
        asking = {r["cell"]: -(-r["n"] // block_queries) for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most `cells` rows
        if not asking:
            return vectors.sparkSession.createDataFrame([], schema)
        number = lambda of: F.create_map(*(F.lit(x) for c in asking for x in (c, of[c])))[F.col("cell")]
        rows_of, asks_of = number(blocks), number(asking)
        every_one = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
        left = queries.select("cell", "vec_id", "embedding", "radius", F.pmod(F.xxhash64("vec_id", F.lit(2)), asks_of).alias("q"), every_one(rows_of).alias("r"))
        right = kept.filter(F.col("cell").isin(*asking)).select("cell", "vec_id", "embedding", "codes", F.pmod(F.xxhash64("vec_id", F.lit(1)), rows_of).alias("r"), every_one(asks_of).alias("q"))
        return left.groupBy("cell", "r", "q").cogroup(right.groupBy("cell", "r", "q")).applyInPandas(meet, schema)

    def meet(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        books, _ = shared.value
        rows = rows.sort_values("vec_id", kind="stable")
        ids, x, q = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()), np.stack(asked["embedding"].to_numpy())
        exact_x, codes = x.astype(np.float64), np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)
        stand = decode(codes, books)
        norms, stand_norms, rest = (exact_x**2).sum(axis=1), (stand**2).sum(axis=1), np.sqrt(((exact_x - stand) ** 2).sum(axis=1))
        out = []
        for at in range(0, len(q), 128):
            query_ids, vectors = asked["vec_id"].to_numpy()[at : at + 128], q[at : at + 128].astype(np.float64)
            products, error = scanned(vectors, codes, books)
            own = query_ids[:, None] == ids[None]
            radius = asked["radius"].to_numpy()[at : at + 128].copy()
            for i, vector in enumerate(vectors):
                found = leading(products[i] - norms / 2, rerank + 1)
                found = found[~own[i, found]]
                if len(found) >= k:
                    radius[i] = min(radius[i], np.sqrt(np.partition(((exact_x[found] - vector) ** 2).sum(axis=1), k - 1)[k - 1]))
            sizes = (vectors**2).sum(axis=1)[:, None]
            slack = 1e-9 * (sizes + norms[None])  # more than rounding in double precision
            least = np.sqrt(np.maximum(sizes + stand_norms[None] - 2 * (products + error[:, None]) - slack, 0)) - rest[None]
            near = ~(least > (radius * (1 + 1e-9))[:, None]) & ~own
            needed = np.flatnonzero(near.any(axis=0))
            squares = sizes + norms[needed][None] - 2 * (vectors @ exact_x[needed].T)
            inside = near[:, needed] & ~(squares - slack[:, needed] > (radius**2)[:, None])
            for i, (query_id, vector) in enumerate(zip(query_ids, vectors, strict=True)):
                found = needed[inside[i]]
                distance = np.sqrt(((exact_x[found] - vector) ** 2).sum(axis=1))
                best = np.lexsort((ids[found], distance))[:k]
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[found][best], "score": distance[best]}))
        return pd.concat(out)

    def leaders(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k)

    wanted = f"vec_id long, embedding {kind}, radius double, cell int"
    near = written(leaders(compared(asked.mapInPandas(lambda frames: needing(frames, True), wanted))), "near")
    bound = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("radius"))
    bounded = asked.join(bound, "vec_id", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))
    far = compared(bounded.mapInPandas(lambda frames: needing(frames, False), wanted))
    return leaders(near.select("query_id", "vec_id", "score").union(far)).select("query_id", "rank", "vec_id", "score")
