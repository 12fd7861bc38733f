"""Nearest neighbours by score-aware (anisotropic) quantisation and exact reranking.

Vectors fall into coarse cells, and what is left after the cell's centre, the
residual, is coded: product codes of four bits per pair of dimensions, fitted so
that error along a residual costs more than error across it, which is what
distorts large inner products. A query, less the centre, is turned into tables
of inner products with the codebooks; scanning a cell's codes with them,
together with each row's exact norm, ranks the rows by approximate Euclidean
distance. The best are measured exactly on their original vectors, and after
them every row that could still be nearer than the k-th of those.

A row's index entry holds its residual's component along the decoded one and the
length of what is left over. With the query's product from the tables they bound
the exact distance from below. A cell is bounded by its centre and radius. Queries
go to their nearest cells first, and then to every cell that can still hold a
nearer row, so the result is that of an exhaustive search; only what has to be
looked at depends on the data.

Index and queries are tables. Both are cut into blocks of bounded size within a
cell, and a block of either meets in one task; a cell or vector that holds a
third of all rows is many blocks.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows without an id. Vectors are searched among those of their own
dimension. Equal distances go to the smaller id. Rows that repeat a query's id
are never its neighbours; of a repeated query id one row is searched for. An
empty table gives an empty result. Only the two named columns are read, so
others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.llm.common import as_table, hash_share, ship


@dataclass(frozen=True)
class AnnConfig:
    k: int = 10
    #: Bound of the rows that the codebooks are fitted on.
    max_train: int = 10_000
    subspace: int = 2
    centres: int = 16
    #: Inner products above this share of the norms' product are the ones to get right.
    threshold: float = 0.2
    fits: int = 3
    #: Coarse cells at most, the sampled vectors that a cell has at least, and the rounds that place their centres.
    cells: int = 128
    cell_sample: int = 64
    cell_rounds: int = 10
    #: Cells that a query searches first; the bound decides on the others.
    first_cells: int = 4
    #: Rows of each block that are measured exactly first, per query; the bound decides on the others.
    rerank: int = 40
    #: Rows and queries, about, that meet in one task.
    block_rows: int = 16_384
    block_queries: int = 1024


class AnisotropicCodes:
    def __init__(self, parts: list[np.ndarray], books: np.ndarray, weight: float):
        self.parts, self.books, self.weight = parts, books, weight

    @staticmethod
    def fit(x: np.ndarray, config: AnnConfig) -> AnisotropicCodes:
        d = x.shape[1]
        width = config.subspace
        parts = [np.arange(a, min(a + width, d)) for a in range(0, d, width)]
        books = np.zeros((len(parts), config.centres, width))
        rng = np.random.RandomState(5)
        for m, dims in enumerate(parts):
            own = x[:, dims]
            centre = own[rng.choice(len(own), config.centres, len(own) < config.centres)].copy()
            for _ in range(8):
                near = ((own[:, None, :] - centre[None]) ** 2).sum(2).argmin(1)
                size = np.bincount(near, minlength=config.centres)
                for j in range(len(dims)):
                    total = np.bincount(near, own[:, j], config.centres)
                    centre[:, j] = np.where(size > 0, total / np.maximum(size, 1), centre[:, j])
            books[m, :, : len(dims)] = centre
        square = config.threshold**2
        codes = AnisotropicCodes(parts, books, max(0.0, (d - 1) * square / (1 - square) - 1))
        for _ in range(config.fits):
            codes.books = codes._refit(x, codes.encode(x))
        return codes

    def _blocks(self, x: np.ndarray) -> np.ndarray:
        """(rows, parts, width), short parts padded with zeros."""
        pad = self.books.shape[0] * self.books.shape[2] - x.shape[1]
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), self.books.shape[0], -1)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes that lower the weighted error by coordinate descent over the parts."""
        blocks = self._blocks(x.astype(np.float64))
        unit = blocks / np.maximum(np.sqrt((x.astype(np.float64) ** 2).sum(1)), 1e-30)[:, None, None]
        rest = [blocks[:, m, None, :] - self.books[m][None] for m in range(len(self.books))]
        across = [(r**2).sum(2) for r in rest]
        along = [(r * unit[:, m, None, :]).sum(2) for m, r in enumerate(rest)]
        codes = np.stack([a.argmin(1) for a in across], 1)
        rows = np.arange(len(x))
        total = sum(along[m][rows, codes[:, m]] for m in range(len(self.books)))
        for _ in range(sweeps):
            for m in range(len(self.books)):
                others = total - along[m][rows, codes[:, m]]
                codes[:, m] = (across[m] + self.weight * (others[:, None] + along[m]) ** 2).argmin(1)
                total = others + along[m][rows, codes[:, m]]
        return codes.astype(np.uint8)

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Codebooks of least weighted error for fixed codes: one linear system."""
        parts, centres, width = self.books.shape
        size = parts * centres * width
        left, right = np.zeros((size, size)), np.zeros(size)
        for a in range(0, len(x), 2000):
            own, code = self._blocks(x[a : a + 2000].astype(np.float64)), codes[a : a + 2000]
            norm = np.sqrt((own**2).sum((1, 2)))
            place = ((np.arange(parts)[None] * centres + code)[:, :, None] * width + np.arange(width)).reshape(len(own), -1)
            spread = np.zeros((len(own), size))
            np.put_along_axis(spread, place, (own / np.maximum(norm, 1e-30)[:, None, None]).reshape(len(own), -1), 1)
            left += self.weight * spread.T @ spread
            right += self.weight * spread.T @ norm
            np.add.at(right, place.ravel(), own.ravel())
            left[np.arange(size), np.arange(size)] += np.bincount(place.ravel(), minlength=size)
        left[np.arange(size), np.arange(size)] += 1e-6
        return np.linalg.solve(left, right).reshape(self.books.shape)

    def decode(self, codes: np.ndarray, d: int) -> np.ndarray:
        return self.books[np.arange(len(self.books))[None], codes].reshape(len(codes), -1)[:, :d]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, parts, centres) inner products."""
        return np.einsum("qmw,mcw->qmc", self._blocks(queries.astype(np.float64)), self.books).astype(np.float32)


def pack_nibbles(codes: np.ndarray) -> np.ndarray:
    even = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return (even[:, ::2] | (even[:, 1::2] << 4)).astype(np.uint8)


def unpack_nibbles(packed: np.ndarray, parts: int) -> np.ndarray:
    out = np.empty((len(packed), packed.shape[1] * 2), np.uint8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out[:, :parts]


def searchable(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite & F.exists(v, lambda x: x != 0))


def split_along(x: np.ndarray, decoded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length of the decoded vector, component of ``x`` along it, length of the rest of ``x``).

    A decoded vector that is far too short gives no direction: its length counts
    as 0, and all of ``x`` is rest.
    """
    length, own = np.sqrt((decoded**2).sum(1)), np.sqrt((x**2).sum(1))
    length = np.where(length > own / 1000, length, 0.0)
    unit = decoded * np.where(length > 0, 1 / np.where(length > 0, length, 1.0), 0.0)[:, None]
    along = (x * unit).sum(1)
    return length, along, np.sqrt(((x - along[:, None] * unit) ** 2).sum(1))


def coarse_centres(x: np.ndarray, config: AnnConfig) -> np.ndarray:
    """Centres of the coarse cells, by k-means from spread-out starts."""
    rng = np.random.RandomState(9)
    count = max(1, min(config.cells, len(x) // config.cell_sample))
    centres = [x[rng.randint(len(x))]]
    far = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < count and far.sum() > 0:
        centres.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
    out = np.stack(centres)
    for _ in range(config.cell_rounds):
        own = cell_of(x, out)
        size = np.bincount(own, minlength=len(out))
        total = np.zeros_like(out)
        np.add.at(total, own, x)
        out = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], out)
    return out


def cell_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)


def build_index(rows: DataFrame, centres: np.ndarray, codes: AnisotropicCodes) -> DataFrame:
    """(cell, vec_id, codes, length, along, rest, embedding, place) of every row, stored; ``place`` numbers the rows."""

    def encode(batches):
        for batch in batches:
            if len(batch):
                x = np.stack(batch["embedding"].array).astype(np.float64)
                cell = cell_of(x, centres)
                x = x - centres[cell]
                code = codes.encode(x)
                length, along, rest = split_along(x, codes.decode(code, x.shape[1]))
                packed = [p.tobytes() for p in pack_nibbles(code)]
                yield pd.DataFrame({"cell": cell, "vec_id": batch["vec_id"], "codes": packed, "length": length, "along": along, "rest": rest, "embedding": batch["embedding"]})

    kind = rows.schema["embedding"].dataType.simpleString()
    coded = rows.mapInPandas(encode, f"cell int, vec_id long, codes binary, length double, along double, rest double, embedding {kind}")
    return as_table(coded.withColumn("place", F.monotonically_increasing_id()), "ann-index")


def _least_squares(product: np.ndarray, slack: float, query: float, length: np.ndarray, along: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Bounds from below of the squared distances of a query of squared norm ``query``.

    ``product`` is the query's product with the decoded vectors, off by
    ``slack`` at most. It gives the query's component along the decoded vector;
    the rests of query and row may at best point the same way.
    """
    inverse = np.where(length > 0, 1 / np.where(length > 0, length, 1.0), 0.0)
    own, off = product * inverse, slack * inverse
    across = np.sqrt(np.maximum(query - np.maximum(np.abs(own) - off, 0.0) ** 2, 0.0))
    norm = along**2 + rest**2
    least = query + norm - 2 * (own * along + off * np.abs(along) + across * rest) - 1e-12 * (query + norm)
    return np.where(np.isnan(least), -np.inf, least)


def _nearest_exact(vectors: np.ndarray, own: np.ndarray, score: np.ndarray, least: np.ndarray, ident: int, query: np.ndarray, reach: float, config: AnnConfig):
    """(rows, distances) of the ``k`` rows nearest to a query: the best by ``score``, then by rising bound until it closes.

    Rows that are further than ``reach`` need not be found.
    """
    rows, far = np.zeros(0, np.intp), np.zeros(0)

    def measure(more: np.ndarray) -> float:
        nonlocal rows, far
        more = more[own[more] != ident]
        exact = np.sqrt(((vectors[more].astype(np.float64) - query) ** 2).sum(1))
        rows, far = np.concatenate([rows, more]), np.concatenate([far, exact])
        best = np.lexsort((own[rows], far))[: config.k]
        rows, far = rows[best], far[best]
        return min(reach, far[-1]) if len(far) == config.k else reach

    def within(places: np.ndarray, edge: float) -> np.ndarray:
        return places[~(least[places] > edge**2 * (1 + 1e-12))]

    open_ = within(np.arange(len(own)), reach)
    if not len(open_):
        return rows, far
    keep = min(max(config.rerank, config.k), len(open_))
    order = np.argpartition(score[open_], keep - 1)
    edge = measure(open_[order[:keep]])
    left = within(open_[order[keep:]], edge)
    left = left[np.argsort(least[left])]
    for a in range(0, len(left), 4096):
        if least[left[a]] > edge**2 * (1 + 1e-12):
            break
        edge = measure(left[a : a + 4096])
    return rows, far


def _frame(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*parts)))))


def _search_block(rows: pd.DataFrame, asked: pd.DataFrame, centres: np.ndarray, codes: AnisotropicCodes, config: AnnConfig) -> pd.DataFrame:
    """query_id, vec_id, score of the nearest rows of one block of a cell, for one block of queries."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if not len(rows) or not len(asked):
        return _frame(out)
    own, (length, along, rest) = rows["vec_id"].to_numpy(), (rows[c].to_numpy() for c in ("length", "along", "rest"))
    norm = along**2 + rest**2
    code = unpack_nibbles(np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1), len(codes.books)).astype(np.intp)
    vectors = np.stack(rows["embedding"].array)
    ids, reach, queries = asked["query_id"].to_numpy(), asked["reach"].to_numpy(), np.stack(asked["embedding"].array).astype(np.float64)
    moved = queries - centres[int(rows["cell"].iat[0])]
    for a in range(0, len(ids), 64):
        table = codes.tables(moved[a : a + 64])
        product = np.zeros((len(table), len(rows)), np.float32)
        for m in range(table.shape[1]):
            product += table[:, m, :][:, code[:, m]]
        # Rounding of the tables and their sums to single precision.
        slack = (table.shape[1] + 2) * (np.abs(table).max(2).sum(1, dtype=np.float64) * 2.0**-23 + float(np.finfo(np.float32).tiny))
        for q in range(len(table)):
            least = _least_squares(product[q].astype(np.float64), slack[q], (moved[a + q] ** 2).sum(), length, along, rest)
            near, far = _nearest_exact(vectors, own, norm / 2 - product[q], least, ids[a + q], queries[a + q], reach[a + q], config)
            out.append((np.full(len(near), ids[a + q]), own[near], far))
    return _frame(out)


def _search(index: DataFrame, sizes: DataFrame, probes: DataFrame, centres: np.ndarray, codes: AnisotropicCodes, config: AnnConfig) -> DataFrame:
    """query_id, vec_id, score: what ``probes`` (cell, query_id, embedding, reach) find in their cells."""
    asked = probes.groupBy("cell").agg(F.count("*").alias("asked"))
    # One row per cell, so at most ``cells`` rows.
    cells = sizes.join(asked, "cell").select("cell", F.ceil(F.col("rows") / config.block_rows).alias("blocks"), F.ceil(F.col("asked") / config.block_queries).alias("query_blocks"))
    cells = F.broadcast(cells)

    def every(number: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(number) - 1))

    left = index.join(cells, "cell").withColumn("b", F.pmod("place", "blocks")).withColumn("q", every("query_blocks")).drop("blocks", "query_blocks")
    right = probes.join(cells, "cell").withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("query_blocks"))).withColumn("b", every("blocks")).drop("blocks", "query_blocks")

    def search(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return _search_block(rows, own, centres, codes, config)

    keys = ["cell", "b", "q"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest_of_one_dimension(rows: DataFrame, asked: DataFrame, size: int, config: AnnConfig) -> DataFrame:
    ident = F.struct(F.xxhash64("vec_id", F.lit("ann")).alias("h"), "vec_id")
    train = rows.where(hash_share(F.col("vec_id"), "ann") < min(1.0, 2 * config.max_train / size)).orderBy(ident).limit(config.max_train).toPandas()
    if not len(train):
        train = rows.orderBy(ident).limit(config.max_train).toPandas()
    x = np.stack(train["embedding"].array).astype(np.float64)
    centres = coarse_centres(x, config)
    codes = AnisotropicCodes.fit(x - centres[cell_of(x, centres)], config)
    index = build_index(rows, centres, codes)
    radius = F.max(F.sqrt(F.col("along") * F.col("along") + F.col("rest") * F.col("rest")))
    sizes = as_table(index.groupBy("cell").agg(F.count("*").alias("rows"), radius.alias("radius")), "ann-cells")
    held = sizes.toPandas().sort_values("cell")  # at most ``cells`` rows
    cells, spans = held["cell"].to_numpy(), held["radius"].to_numpy()

    def distances(batch: pd.DataFrame) -> np.ndarray:
        q = np.stack(batch["embedding"].array).astype(np.float64)
        return np.sqrt(((q[:, None, :] - centres[cells][None]) ** 2).sum(2))

    def probe(choose):
        def run(batches):
            for batch in batches:
                for a in range(0, len(batch), 256):
                    part = batch.iloc[a : a + 256]
                    q, c = np.nonzero(choose(distances(part), part["reach"].to_numpy()))
                    yield pd.DataFrame({"cell": cells[c], "query_id": part["vec_id"].to_numpy()[q], "embedding": part["embedding"].array[q], "reach": part["reach"].to_numpy()[q]})

        return run

    def is_first(far: np.ndarray) -> np.ndarray:
        order = np.argsort(far, 1, kind="stable").argsort(1, kind="stable")
        return order < config.first_cells

    kind = asked.schema["embedding"].dataType.simpleString()
    schema = f"cell int, query_id long, embedding {kind}, reach double"
    asked = as_table(asked.withColumn("reach", F.lit(float("inf"))), "ann-queries")
    near = as_table(asked.mapInPandas(probe(lambda far, reach: is_first(far)), schema), "ann-near")
    first = as_table(_best(_search(index, sizes, near, centres, codes, config), config.k), "ann-first")
    reach = first.where(F.col("rank") == config.k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reach"))
    known = asked.drop("reach").join(reach, "vec_id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))

    def open_cells(far: np.ndarray, reach: np.ndarray) -> np.ndarray:
        return ~is_first(far) & (far - spans[None] <= reach[:, None] * (1 + 1e-9) + 1e-9 * far)

    rest = as_table(known.mapInPandas(probe(open_cells), schema), "ann-open")
    second = _search(index, sizes, rest, centres, codes, config)
    return _best(first.select("query_id", "vec_id", "score").unionByName(second), config.k)


def nearest(vectors: DataFrame, queries: DataFrame, vector: str = "embedding", key: str = "vec_id", config: AnnConfig = AnnConfig()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of every row of ``queries``."""
    ship()
    spark = vectors.sparkSession
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = searchable(vectors, vector, key)
    asked = searchable(queries, vector, key)
    d = F.size("embedding")
    for one in rows.groupBy(d.alias("d")).count().orderBy("d").collect():  # a row per dimension
        own = asked.where(d == one["d"]).dropDuplicates(["vec_id"])
        found = _nearest_of_one_dimension(rows.where(d == one["d"]), own, one["count"], config)
        out = out.unionByName(found.select("query_id", "rank", "vec_id", "score"))
    return out
