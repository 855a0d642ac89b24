"""Exact search for the vectors with the largest inner products.

Every component x counts as the whole number floor(1024 x), so scores are integers and ties are exact. Queries are the rows
whose id is divisible by ``DIVISOR``; candidates are all rows but the query's own (those with its id). The work is a grid of
tiles: query blocks times candidate shards. A tile holds at most ``TILE_BYTES`` of either, so queries are sent to every
shard and candidates to every block, (queries x shards + candidates x blocks) rows in all, the least for square tiles. There
are ``SHARDS`` shards at least, so that small tables are spread too, and more as the table grows. Nothing is broadcast and
nothing but three counters reaches the driver.

Inside a tile, candidates stand in order of their ids. A block of queries is multiplied with a block of candidates in one
matrix product whose last column adds the place of the candidate, so that its entries are unique and ordered by score,
then by id; a partial selection takes the best of each row. Products are exact in double precision; blocks that could
leave it are multiplied as Python numbers. The lists of a query are merged in a tree, ``FAN`` shards at a time.

Results on edges: rows without a vector, or with a component that is null, not finite or too large for a long, take no part.
Vectors are only compared with those of their own length. Wholly equal rows count once; rows of one id with
different vectors are candidates, and queries, each. A null id is no query, and as a candidate stands behind all others
of its score. Scores beyond a long are held at its ends. Without candidates a query has no rows. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm.common import BOOK, col, table
from forumlens.llm.vectors import as_list, by_length, scaled, usable

TOP = 10
DIVISOR = 100
TILE_BYTES = 64 << 20    # of the components of a tile's queries, and of its candidates, as doubles
SHARDS = 32
FAN = 16
QUERIES, CANDIDATES = 512, 8192   # rows of one matrix product; the latter a power of two
EXACT = float(1 << 53)
_END = (1 << 63) - 1


def exact_products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products as Python numbers, held inside a long."""
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    found = whole(queries) @ whole(candidates).T
    return np.array([[min(max(int(x), -_END), _END) for x in row] for row in found], np.int64).reshape(found.shape)


def best_of_block(queries: np.ndarray, candidates: np.ndarray, own: list[tuple[int, int, int]], top: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and places of the best candidates of each query, unordered; place -1 is none. ``own``: (query, first, last)
    places that are the query's own rows."""
    n, width = len(candidates), queries.shape[1]
    take = min(top, n)
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(width, 1)
    if (reach + 1) * CANDIDATES < EXACT:
        left = np.column_stack([queries * CANDIDATES, np.ones(len(queries))])
        right = np.column_stack([candidates, np.arange(CANDIDATES - 1, CANDIDATES - 1 - n, -1)])
        keys = left @ right.T
        for q, first, last in own:
            keys[q, first:last] = -np.inf
        places = np.argpartition(keys, n - take, axis=1)[:, n - take:] if take < n else np.tile(np.arange(n), (len(queries), 1))
        chosen = np.take_along_axis(keys, places, 1)
        none = np.isneginf(chosen)
        scores = np.floor(np.where(none, 0, chosen) / CANDIDATES).astype(np.int64)
    else:
        scores = exact_products(queries, candidates)
        none = np.zeros(scores.shape, bool)
        for q, first, last in own:
            none[q, first:last] = True
        places = np.lexsort((-scores, none), axis=1)[:, :take]    # stable, so equal scores stay in order
        scores, none = np.take_along_axis(scores, places, 1), np.take_along_axis(none, places, 1)
    return np.where(none, -_END, scores), np.where(none, -1, places)


def best_of_tile(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and places of the best candidates of each query, best first. Candidates stand in order; ``ids`` are those
    of the first of them, the others have none."""
    first, last = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    all_scores, all_places = [], []
    for q in range(0, len(queries), QUERIES):
        part = queries[q:q + QUERIES]
        scores, places = np.zeros((len(part), 0), np.int64), np.zeros((len(part), 0), np.int64)
        for c in range(0, len(candidates), CANDIDATES):
            block = candidates[c:c + CANDIDATES]
            f, t = (np.clip(x[q:q + QUERIES] - c, 0, len(block)) for x in (first, last))
            own = [(i, int(f[i]), int(t[i])) for i in np.flatnonzero(t > f).tolist()]
            found, at = best_of_block(part, block, own, top)
            scores, places = np.hstack([scores, found]), np.hstack([places, np.where(at < 0, -1, at + c)])
            order = np.lexsort((places, -scores, places < 0), axis=1)[:, :top]
            scores, places = np.take_along_axis(scores, order, 1), np.take_along_axis(places, order, 1)
        all_scores.append(scores)
        all_places.append(places)
    return np.vstack(all_scores), np.vstack(all_places)


_LIST = pa.list_(pa.struct([("less", pa.int64()), ("none", pa.bool_()), ("vec_id", pa.int64())]))
_FOUND = pa.schema([("query_id", pa.int64()), ("mark", pa.int64()), ("part", pa.int32()), ("best", _LIST)])


def _tile(top: int):
    def run(rows: pa.Table) -> pa.Table:
        """The best candidates of the tile for each of its queries."""
        is_query = rows.column("is_query").to_numpy().astype(bool)
        marks = rows.column("mark").to_numpy()
        id_column = rows.column("id").combine_chunks()
        none = id_column.is_null().to_numpy(zero_copy_only=False)
        ids = id_column.fill_null(_END).to_numpy()
        shard = rows.column("shard")[0].as_py()
        out = []
        for _, at, matrix in by_length(rows.column("vector")):
            order = np.lexsort((marks[at], ids[at], none[at], is_query[at]))
            at, matrix = at[order], scaled(matrix[order])
            again = np.r_[False, (marks[at][1:] == marks[at][:-1]) & (ids[at][1:] == ids[at][:-1]) & (none[at][1:] == none[at][:-1])
                          & (is_query[at][1:] == is_query[at][:-1]) & (matrix[1:] == matrix[:-1]).all(axis=1)]
            at, matrix = at[~again], matrix[~again]
            n = int((~is_query[at]).sum())
            if n == len(at) or not n:
                continue
            known = int((~none[at[:n]]).sum())
            scores, places = best_of_tile(matrix[n:], ids[at[n:]], matrix[:n], ids[at[:known]], top)
            there = places >= 0
            found = at[places[there]]
            lists = pa.ListArray.from_arrays(
                np.r_[0, np.cumsum(there.sum(axis=1))].astype(np.int32),
                pa.StructArray.from_arrays([pa.array(-scores[there]), pa.array(none[found]),
                                            pa.array(ids[found], mask=none[found])], ["less", "none", "vec_id"]))
            out.append(pa.Table.from_arrays([pa.array(ids[at[n:]]), pa.array(marks[at[n:]]),
                                             pa.array(np.full(len(at) - n, shard, np.int32)), lists.cast(_LIST)], schema=_FOUND))
        return pa.concat_tables(out) if out else _FOUND.empty_table()

    return run


def _once(batches):
    """Rows of each batch that are equal in id and vector once, so that no shard gets very many copies of one row."""
    for batch in batches:
        seen: dict = {}
        for i, key in enumerate(zip(batch.column("id").to_pylist(), batch.column("mark").to_pylist())):
            seen.setdefault(key, []).append(i)
        keep = []
        for group in seen.values():
            vectors: set = set()
            for i in group:
                value = tuple(batch.column("vector")[i].as_py()) if len(group) > 1 else ()
                if value not in vectors:
                    vectors.add(value)
                    keep.append(i)
        yield batch if len(keep) == batch.num_rows else batch.take(pa.array(sorted(keep)))


def search(df: DataFrame, vector: str = "embedding", key: str = "vec_id", top: int = TOP, divisor: int = DIVISOR,
           tile_bytes: int = TILE_BYTES, shards: int = SHARDS, fan: int = FAN) -> DataFrame:
    """(query_id, rank, vec_id, score) of the best candidates of every query."""
    rows = usable(df, vector).select(col(key).cast("long").alias("id"), as_list(df, vector).alias("vector"))
    rows = rows.withColumn("mark", F.xxhash64("vector"))
    is_query = F.pmod("id", F.lit(divisor)) == 0
    n, n_queries, width = rows.agg(F.count(F.lit(1)), F.count_if(is_query), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    per_tile = max(1, tile_bytes // (8 * max(width, 1)))
    n_shards, n_blocks = max(shards, -(-n // per_tile)), max(1, -(-n_queries // per_tile))
    rows = rows.mapInArrow(_once, rows.schema)
    candidates = rows.select("*", F.lit(False).alias("is_query"), F.pmod(F.xxhash64("id", "mark"), F.lit(n_shards)).cast("int").alias("shard"),
                             F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    queries = rows.filter(is_query).select("*", F.lit(True).alias("is_query"), F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"),
                                           F.pmod(F.xxhash64("id", "mark"), F.lit(n_blocks)).cast("int").alias("block"))
    tiles = candidates.unionByName(queries).repartition(n_shards * n_blocks, "shard", "block").groupBy("shard", "block")
    found = tiles.applyInArrow(_tile(top), "query_id long, mark long, part int, best array<struct<less:long,none:boolean,vec_id:long>>")
    width = n_shards
    while width > 1:      # one list of a query for every ``fan`` of its lists
        found = (found.groupBy("query_id", "mark", F.floor(F.col("part") / fan).cast("int").alias("part"))
                 .agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, top).alias("best")))
        width = -(-width // fan)
    return found.select("query_id", F.posexplode("best").alias("place", "one")).select(
        "query_id", (F.col("place") + 1).alias("rank"), "one.vec_id", (-F.col("one.less")).alias("score"))


@BOOK.add("op12_tiled_search", """
    WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
          FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= 10""")
def tiled_search(spark, sf_dir):
    """The ten best partners of every hundredth vector."""
    return search(table(spark, sf_dir, "embeddings"))
