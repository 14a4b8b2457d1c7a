"""Most similar vectors for every vector: randomly rotated one-bit codes with error bounds.

Every vector is turned by one random rotation and kept as the signs of its coordinates (64 dimensions are one
machine word) plus one correction scalar. Inside a list of an inverted index, inner products are estimated from
popcounts of those words against 4-bit planes of the query; the estimator's error bound decides which pairs are worth an
exact inner product, the bound being compared with each row's k-th best so far. Lists come from spherical k-means on a
bounded sample; every row is indexed under its nearest `spread` centroids, so that two near vectors miss each other only if
those sets do not meet. The number of lists grows with the data: lists that are too large for one task get lists of their
own, fitted on a bounded sample of each, so that a vector is moved a fixed number of times whatever the size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.tables import cut, table

#: Rows of the sample that the first lists are fitted on, and of the sample of each large type or list beyond that.
SAMPLE_ROWS, OWN_SAMPLE = 24_000, 4_096
#: Rows that are compared all with all at once (a longer list is split within its task), and rows of a list that one task
#: takes (a longer list gets lists of its own).
BLOCK_ROWS, LIST_ROWS = 4_096, 1 << 16
#: Nearest lists that a row of a large list is kept under among that list's own.
SPREAD_BELOW = 2
#: Width of the estimator's confidence interval, in units of its standard deviation.
EPSILON = 3.0


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 as words of 64 bits, (n, ceil(dim / 64))."""
    n, dim = bits.shape
    padded = np.zeros((n, -(-dim // 64) * 64), np.uint8)
    padded[:, :dim] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


class Codes:
    """One-bit codes of unit vectors, and the same vectors as queries in 4-bit planes."""

    def __init__(self, unit: np.ndarray, turn: np.ndarray):
        dim = self.dim = unit.shape[1]
        y = unit.astype(np.float32) @ turn.T
        bits = y > 0
        self.words = pack(bits)
        self.ones = bits.sum(1).astype(np.float32)
        self.fit = np.maximum(np.abs(y).sum(1) / np.sqrt(dim), 1e-6).astype(np.float32)
        self.slack = (np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit * (EPSILON / np.sqrt(max(dim - 1, 1)))).astype(np.float32)
        self.low = y.min(1)
        self.step = np.maximum((y.max(1) - self.low) / 15, 1e-9)
        levels = np.rint((y - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.level_sum = levels.sum(1).astype(np.float32)
        self.planes = [pack((levels >> j) & 1) for j in range(4)]

    def upper(self, q: slice, d: slice) -> np.ndarray:
        """Upper bounds of the inner products of queries `q` with the coded vectors `d`."""
        root = np.sqrt(self.dim)
        total = np.zeros((q.stop - q.start, d.stop - d.start), np.float32)
        for j, plane in enumerate(self.planes):
            for w in range(self.words.shape[1]):
                total += np.bitwise_count(plane[q, None, w] & self.words[None, d, w]) * np.float32(1 << j)
        low, step = self.low[q, None], self.step[q, None]
        total *= 2 * step / root
        total += (2 / root) * low * self.ones[None, d]
        total -= step / root * self.level_sum[q, None] + low * root
        total /= self.fit[None, d]
        return total + self.slack[None, d] + step / 2


def fit_lists(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centroids of spherical k-means."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample)))
    c = sample[rng.choice(len(sample), lists, replace=False)].astype(np.float32)
    for _ in range(rounds if lists > 1 else 0):
        best = np.argmax(sample @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, best, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def nearest(unit: np.ndarray, centroids: np.ndarray, spread: int) -> np.ndarray:
    s = unit @ centroids.T
    spread = min(spread, centroids.shape[0])
    return np.argpartition(-s, spread - 1, axis=1)[:, :spread]


def valid_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and unit vectors of the rows with `dim` finite values that are not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0))
    at = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(at)).flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(len(at), dim) if len(at) else np.zeros((0, dim))
    norm = np.sqrt((x * x).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return at[ok], x[ok] / norm[ok, None]


def top_per_row(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `k` entries of each `a` with the greatest `s`, ties by smaller `b`."""
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    start = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(start, np.arange(len(a)), 0)) if len(a) else np.zeros(0, int)
    keep = np.arange(len(a)) - first < k
    return a[keep], b[keep], s[keep]


def merged(found: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `k` best of each row out of several findings; a pair may be in more than one."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, s = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((b, a))
    a, b, s = a[order], b[order], s[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    return top_per_row(a[new], b[new], s[new], k)


def search_block(ids: np.ndarray, unit: np.ndarray, turn: np.ndarray, k: int, least: float):
    """For each row its `k` best others with cosine >= `least`: all rows against all, in both directions at once. A pair
    whose bound is below the k-th best of both its rows so far is left out."""
    n = len(ids)
    codes = Codes(unit, turn)
    place = np.argsort(ids, kind="stable")
    kth = np.full(n, least, np.float32)
    found: list[tuple] = []
    held = 0
    for i in range(0, n, 256):
        q, d = slice(i, min(i + 256, n)), slice(i, n)
        r, c = np.nonzero(codes.upper(q, d) >= np.minimum(kth[q, None], kth[None, d]))
        r, c = r + q.start, c + d.start
        keep = c > r
        r, c = r[keep], c[keep]
        for j in range(0, len(r), 1 << 18):
            rr, cc = r[j : j + (1 << 18)], c[j : j + (1 << 18)]
            s = np.einsum("ij,ij->i", unit[rr], unit[cc])
            ok = (s >= np.minimum(kth[rr], kth[cc])) & (s >= least) & (ids[rr] != ids[cc])
            rr, cc, s = rr[ok], cc[ok], s[ok]
            found.append((np.r_[ids[rr], ids[cc]], np.r_[ids[cc], ids[rr]], np.r_[s, s]))
            held += 2 * len(s)
            if held > max(1 << 18, 4 * k * n):
                found = [merged(found, k)]
                a, _, s = found[0]
                held = len(a)
                last = np.flatnonzero(np.r_[a[1:] != a[:-1], True])
                full = last[(last >= k - 1) & (a[np.maximum(last - k + 1, 0)] == a[last])]
                # (rounded down a little, so that ties with the k-th best are still seen)
                kth[place[np.searchsorted(ids[place], a[full])]] = np.maximum(least, s[full] - 1e-6)
    return merged(found, k)


def search_list(ids: np.ndarray, unit: np.ndarray, turn: np.ndarray, k: int, least: float, spread: int):
    """search_block() of a list of any length: a long one is split by lists of its own first."""
    n = len(ids)
    if n <= 2 * BLOCK_ROWS:
        return search_block(ids, unit, turn, k, least)
    some = unit[:: max(1, n // OWN_SAMPLE)].astype(np.float32)
    c = fit_lists(some, min(-(-2 * spread * n // BLOCK_ROWS), max(2, len(some) // 4)))
    to = nearest(unit.astype(np.float32), c, spread)
    found = []
    for j in range(len(c)):
        at = np.flatnonzero((to == j).any(1))
        # what cannot be split (all rows alike) is compared as it is
        found.append((search_list if len(at) < 0.7 * n else search_block)(ids[at], unit[at], turn, k, least, *([spread] if len(at) < 0.7 * n else [])))
    return merged(found, k)


def latest_objects(df: DataFrame) -> DataFrame:
    """Of each (repo_id, object_id) the row with the latest created_at (ties: greater id)."""
    rows = df.select("id", "repo_id", "object_id", F.lower(F.trim("object_type")).alias("kind"), "embedding", "created_at")
    last = Window.partitionBy("repo_id", "object_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("id", "kind", "embedding")


PLACED = "kind string, place int, sub int, id long, unit binary"
OUT = "id long, other_id long, cosine double"


def _units(batch: pa.Table | pa.RecordBatch, dim: int) -> np.ndarray:
    unit = np.frombuffer(b"".join(batch.column("unit").to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)
    return unit / np.sqrt((unit * unit).sum(1))[:, None]


def first_lists(vectors: DataFrame, dim: int) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """Centroids of each object type, and the rows of each of more than LIST_ROWS. Centroids come from a sample of SAMPLE_ROWS rows, and of OWN_SAMPLE of each type of more than
    LIST_ROWS rows. A type without centroids has fewer rows, and is one list."""
    counts = vectors.groupBy("kind").count()
    many = F.collect_list(F.when(F.col("count") > LIST_ROWS, F.struct("kind", "count"))).alias("large")
    told = counts.agg(F.sum("count").alias("total"), many).first()
    total, large = told["total"], {r["kind"]: r["count"] for r in told["large"]}
    if not total:
        return {}, {}
    share = F.lit(SAMPLE_ROWS / total)
    rare = {k: OWN_SAMPLE / n for k, n in large.items() if OWN_SAMPLE / n > SAMPLE_ROWS / total}
    if rare:
        share = F.coalesce(F.create_map(*[F.lit(x) for pair in rare.items() for x in pair])[F.col("kind")], share)
    sample = vectors.filter(F.rand(3) < share).toArrow()
    at, unit = valid_vectors(sample["embedding"], dim)
    names = np.asarray(sample["kind"].to_pylist(), object)[at]
    out = {}
    for name in sorted(set(names)):
        own = unit[names == name].astype(np.float32)
        rows = large.get(name, total * len(own) / max(len(sample), 1))
        out[name] = fit_lists(own, int(min(max(1, np.sqrt(rows)), max(1, len(own) // 4))))
    return out, large


def refined(placed: DataFrame, dim: int, seed: int = 7) -> DataFrame:
    """`placed` with the rows of every list of more than LIST_ROWS under lists of its own (column sub)."""
    placed = cut(placed, "vector-lists")
    large = placed.groupBy("kind", "place").count().filter(F.col("count") > LIST_ROWS)
    large = cut(large.withColumn("lots", F.ceil(F.col("count") / LIST_ROWS).cast("int")), "vector-large-lists")
    schema = "kind string, place int, lots int, centroids binary"

    def fitted(own: pa.Table) -> pa.Table:
        unit = _units(own, dim).astype(np.float32)
        lists = int(min(4 * SPREAD_BELOW * own.column("lots")[0].as_py(), max(2, len(unit) // 4)))
        return pa.table({"kind": own.column("kind")[:1], "place": own.column("place")[:1], "lots": own.column("lots")[:1], "centroids": pa.array([fit_lists(unit, lists).tobytes()], pa.binary())})

    def below(rows: pa.Table, lists: pa.Table) -> pa.Table:
        c = np.frombuffer(lists.column("centroids")[0].as_py(), np.float32).reshape(-1, dim) if len(lists) else np.ones((1, dim), np.float32)
        to = nearest(_units(rows, dim).astype(np.float32), c, SPREAD_BELOW)
        again = rows.take(pa.array(np.repeat(np.arange(len(rows)), to.shape[1])))
        return pa.table({"kind": again.column("kind"), "place": again.column("place"), "sub": pa.array(to.ravel().astype(np.int32)), "id": again.column("id"), "unit": again.column("unit")})

    own = placed.join(large, ["kind", "place"])
    some = own.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.col("count")) < OWN_SAMPLE).select("kind", "place", "lots", "unit")
    lists = some.groupBy("kind", "place").applyInArrow(fitted, schema)
    lists = lists.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    rows = own.withColumn("lot", F.pmod(F.xxhash64("id"), F.col("lots")).cast("int")).select("kind", "place", "lot", "id", "unit")
    split = rows.groupBy("kind", "place", "lot").cogroup(lists.groupBy("kind", "place", "lot")).applyInArrow(below, PLACED)
    return placed.join(large, ["kind", "place"], "left_anti").select(*split.columns).unionByName(split)


def most_similar(df: DataFrame, k: int = 10, least: float = 0.9, dim: int = 64, spread: int | None = None) -> DataFrame:
    """For every valid vector its `k` most similar others of the same object type with cosine >= `least`.

    In: id, repo_id, object_id, object_type, embedding, created_at; more columns are ignored. Out: id, other_id, cosine.
    Rows that are not the latest of their object, and vectors that are null, of another length, all zero or with a null,
    NaN or infinite value give nothing; a null object_type is a type of its own. Ties go to the smaller id; an id never
    meets itself. An empty table gives an empty result. Of equal vectors only the k + 1 smallest ids enter the search: all
    others have the same neighbours as the last of these, as k copies with smaller ids stand before any later one.
    The search is approximate only in that two vectors must share one of their `spread` nearest lists (3 where `least` is .8
    or more, else 8: less similar vectors meet less often).
    """
    spark = df.sparkSession
    spread = spread or (3 if least >= 0.8 else 8)
    plain = df.select(F.coalesce(F.lower(F.trim("object_type")), F.lit("")).alias("kind"), "embedding").filter(F.size("embedding") == dim)
    index, large = first_lists(plain, dim)
    shared, turn = spark.sparkContext.broadcast(index), rotation(dim)

    def listed(batches):
        """Each row under its nearest lists."""
        for batch in batches:
            at, unit = valid_vectors(batch.column("embedding"), dim)
            if not len(at):
                continue
            kind = np.asarray(batch.column("kind").fill_null("").to_pylist(), object)[at]
            ids = np.asarray(batch.column("id"))[at]
            for name in set(kind):
                own = np.flatnonzero(kind == name)
                c = shared.value.get(name)
                to = nearest(unit[own].astype(np.float32), c, spread) if c is not None else np.zeros((len(own), 1), int)
                row = np.repeat(own, to.shape[1])
                raw = unit[row].astype(np.float32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "kind": pa.array([name] * len(row), pa.string()),
                        "place": pa.array(to.ravel().astype(np.int32)),
                        "sub": pa.array(np.zeros(len(row), np.int32)),
                        "id": pa.array(ids[row], pa.int64()),
                        "unit": pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(row), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary()),
                    }
                )

    def searched(own: pa.Table) -> pa.Table:
        a, b, s = search_list(np.asarray(own["id"]), _units(own, dim), turn, k, least, spread)
        return pa.table({"id": pa.array(a, pa.int64()), "other_id": pa.array(b, pa.int64()), "cosine": pa.array(s, pa.float64())})

    def best(near: DataFrame) -> DataFrame:
        first = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other_id")
        return near.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k).drop("_n")

    def search(rows: DataFrame) -> DataFrame:
        placed = rows.mapInArrow(listed, PLACED)
        # a list holds its even share of rows in the mean; only where that nears what a task takes are they counted
        if any(8 * spread * n > LIST_ROWS * len(index.get(name, [1])) for name, n in large.items()):
            placed = refined(placed, dim)
        near = placed.groupBy("kind", "place", "sub").applyInArrow(searched, OUT)
        return best(near.groupBy("id", "other_id").agg(F.max("cosine").alias("cosine")))

    rows = latest_objects(df)
    same = [F.coalesce("kind", F.lit("")).alias("kind"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(7), "embedding").alias("h2")]
    full = F.exists("embedding", lambda v: v != 0) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v))
    copies = plain.filter(full).select(*same).groupBy("kind", "h1", "h2").count().filter(F.col("count") > k + 1).drop("count")
    if copies.isEmpty():
        return search(rows)
    keyed = cut(rows.select("id", "embedding", *same), "vector-rows")
    copies = cut(copies, "vector-copies")
    crowd = keyed.join(copies, ["kind", "h1", "h2"], "left_semi")
    first = crowd.withColumn("_n", F.row_number().over(Window.partitionBy("kind", "h1", "h2").orderBy("id"))).filter(F.col("_n") <= k + 1)
    near = cut(search(keyed.join(copies, ["kind", "h1", "h2"], "left_anti").select("id", "kind", "embedding").unionByName(first.select("id", "kind", "embedding"))), "vector-near")
    last = first.filter(F.col("_n") == k + 1).select("kind", "h1", "h2", F.col("id").alias("last"))
    alike = last.join(near, F.col("last") == F.col("id")).select("kind", "h1", "h2", "last", "other_id", "cosine")
    rest = crowd.select("id", "kind", "h1", "h2").join(alike, ["kind", "h1", "h2"]).filter("id > last").select("id", "other_id", "cosine")
    return near.unionByName(rest)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = most_similar(table(spark, sf_dir, "object_embeddings"))
    return near.select(F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).distinct()
