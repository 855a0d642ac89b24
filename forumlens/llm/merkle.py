"""Merkle manifest of a table: a tree of SHA-256 hashes whose parents keep the hash state before each child's slot.

A row is a leaf: the hash of its fields, each written as its byte count, a colon and its value, or a dash if null. The leaves
of each group stand in order of the key; every two consecutive nodes become the hash of their hexadecimal digests, a last
single one the hash of its own, until one is left, the subroot. Subroots, in order of the group, become the root likewise.

A digest in hexadecimal is 64 bytes, exactly one block of SHA-256, so the state before a slot is what compressing the
children left of it leaves: 32 bytes that can be kept and sent along. ``SHA-256`` is written here as array operations that
work on many messages at once and start from any such state (``compress``). To fold a changed child, the state before its
slot is resumed with the new digest and the siblings to the right; siblings to the left are not hashed again.

Positions come from one range exchange by (group, key, digest) and counts of rows per partition. Trees are built in blocks of
2^``DEPTH`` consecutive nodes, one task each, which also fold their own changed leaves and start the hash of each proof;
roots of blocks are nodes of the next round. A row gets the states and siblings above its block by a join with its
block, and the folds and proof hashes resume there. No task sees more than a block, and nothing reaches the driver but
the number of rounds.

Results on edges: null keys stand first, null groups are a group before all others. Rows equal in key are ordered by their
digest; wholly equal rows are leaves next to each other. A null, like the empty text, is a value of its own (``-`` and ``0:``).
A change of a null stays null, and rows with a null key are not changed. A table with one row has its leaf as
subroot and root, and the proof of no siblings (the hash of nothing). An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.llm.common import BOOK, col, numbered, table
from forumlens.session import cut_lineage, small_side

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DEPTH = 12
FOLD_ROWS = 8192         # rows whose upper levels are folded together
LANES = 4096             # messages that are compressed together, so that arrays stay in the processor's cache


# --- SHA-256 over many messages -----------------------------------------------------------------------------
def _primes(n: int) -> list[int]:
    found: list[int] = []
    number = 2
    while len(found) < n:
        if all(number % p for p in found):
            found.append(number)
        number += 1
    return found


def _root(value: int, power: int) -> int:
    """The largest whole number whose power is at most the value."""
    low, high = 0, 1 << (value.bit_length() // power + 1)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if middle ** power <= value else (low, middle)
    return low


_WORD = (1 << 32) - 1
ROUND = [_root(p << 96, 3) & _WORD for p in _primes(64)]                      # fractions of the cube roots of primes
START = np.array([[_root(p << 64, 2) & _WORD] for p in _primes(8)], np.uint32)   # and of their square roots


def _schedule(words: list) -> list:
    """The 64 round words of a block, round constants added; on arrays or on Python numbers."""
    w = list(words)
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        if isinstance(a, int):
            turn = lambda x, r: (x >> r | x << (32 - r)) & _WORD
            w.append((w[t - 16] + (turn(a, 7) ^ turn(a, 18) ^ a >> 3) + w[t - 7] + (turn(b, 17) ^ turn(b, 19) ^ b >> 10)) & _WORD)
        else:
            w.append(w[t - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> 3)) + w[t - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> 10)))
    return [np.uint32((x + k) & _WORD) if isinstance(x, int) else x + np.uint32(k) for x, k in zip(w, ROUND)]


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> by) | (x << (32 - by))


def _rounds(state: np.ndarray, words: list) -> np.ndarray:
    a, b, c, d, e, f, g, h = state
    for word in words:
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + word
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.stack([a, b, c, d, e, f, g, h]) + state


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8 x n words) after one more block (16 x n words) of each message."""
    if state.shape[1] <= LANES:
        return _rounds(state, _schedule(list(block))) if state.shape[1] else state
    return np.hstack([compress(state[:, i:i + LANES], block[:, i:i + LANES]) for i in range(0, state.shape[1], LANES)])


_END_WORDS: dict[int, list] = {}


def finish(state: np.ndarray, blocks: int) -> np.ndarray:
    """Digests (8 x n words) of messages of so many whole blocks."""
    if blocks not in _END_WORDS:
        _END_WORDS[blocks] = _schedule([1 << 31, *[0] * 13, blocks * 512 >> 32, blocks * 512 & _WORD])
    if state.shape[1] <= LANES:
        return _rounds(state, _END_WORDS[blocks]) if state.shape[1] else state
    return np.hstack([finish(state[:, i:i + LANES], blocks) for i in range(0, state.shape[1], LANES)])


def finish_each(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages of different numbers of blocks."""
    out = np.empty_like(state)
    for n in np.unique(blocks).tolist():
        out[:, blocks == n] = finish(state[:, blocks == n], n)
    return out


_HEX = np.frombuffer("".join(f"{b:02x}" for b in range(256)).encode(), np.uint8).reshape(256, 2)


def in_hex(digests: np.ndarray) -> np.ndarray:
    """Digests (8 x n words) as the blocks (16 x n words) of their hexadecimal text."""
    raw = np.ascontiguousarray(digests.T).astype(">u4").view(np.uint8)
    return np.ascontiguousarray(_HEX[raw].reshape(len(raw), 64).view(">u4").astype(np.uint32).T)


def from_bytes(values: Sequence[bytes]) -> np.ndarray:
    """Digests or states of 32 bytes each as 8 x n words."""
    return np.ascontiguousarray(np.frombuffer(b"".join(values), ">u4").reshape(-1, 8).astype(np.uint32).T)


def to_bytes(words: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(words.T).astype(">u4").tobytes()
    return [raw[i:i + 32] for i in range(0, len(raw), 32)]


def started(n: int) -> np.ndarray:
    return np.repeat(START, n, axis=1)


# --- blocks of a tree ---------------------------------------------------------------------------------------
LONE, LEFT, RIGHT = 0, 1, 2
STEP = 65                # bytes of a path's step: kind, state before the slot, sibling


class Block:
    """Consecutive nodes and the parents above them, up to so many levels."""

    def __init__(self, nodes: np.ndarray, levels: int):
        self.nodes, self.states = [nodes], []
        for _ in range(levels):
            below = self.nodes[-1]
            right = below[:, 1::2]
            state = compress(started((below.shape[1] + 1) // 2), in_hex(below[:, 0::2]))   # kept: before the right slot
            n = right.shape[1]
            parents = finish(compress(state[:, :n], in_hex(right)), 2)
            self.states.append(state)
            self.nodes.append(np.hstack([parents, finish(state[:, n:], 1)]))

    @property
    def root(self) -> np.ndarray:
        return self.nodes[-1]

    def steps(self, place: np.ndarray):
        """For each level: kind, state before the slot, and sibling (zeros where there is none) of the nodes on the way up."""
        for nodes, states in zip(self.nodes, self.states):
            sibling = place ^ 1
            kind = np.where(place & 1 == 1, RIGHT, np.where(sibling < nodes.shape[1], LEFT, LONE))
            state = np.where(kind == RIGHT, states[:, place >> 1], START)
            other = np.where(kind == LONE, np.uint32(0), nodes[:, np.minimum(sibling, nodes.shape[1] - 1)])
            yield kind, state, other
            place = place >> 1


def fold_step(value: np.ndarray, kind: np.ndarray, state: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The parents' digests with the nodes replaced: states resumed with the new digest and the sibling to the right."""
    state = compress(state, in_hex(value))
    left = kind == LEFT
    state[:, left] = compress(state[:, left], in_hex(other[:, left]))
    return finish_each(state, np.where(kind == LONE, 1, 2))


def proof_step(state: np.ndarray, count: np.ndarray, kind: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of a proof after its next sibling, if there is one."""
    has = kind != LONE
    state = state.copy()
    state[:, has] = compress(state[:, has], in_hex(other[:, has]))
    return state, count + has


def paths(block: Block, place: np.ndarray) -> list[bytes]:
    """The steps from each node to the root of its block."""
    parts = [np.hstack([kind.astype(np.uint8)[:, None], *[np.ascontiguousarray(x.T).astype(">u4").view(np.uint8) for x in (state, other)]])
             for kind, state, other in block.steps(place)]
    return [row.tobytes() for row in np.hstack(parts)] if parts else [b""] * len(place)


def follow(path: bytes, leaf: str) -> str:
    """The root that a leaf leads to along a path; both digests in hexadecimal."""
    value = from_bytes([bytes.fromhex(leaf)])
    for at in range(0, len(path), STEP):
        state, other = (from_bytes([path[at + i:at + i + 32]]) for i in (1, 33))
        value = fold_step(value, np.array([path[at]]), state, other)
    return to_bytes(value)[0].hex()


def _levels(n: int, depth: int) -> int:
    """Levels of a block in a tree of n nodes."""
    return min(depth, (n - 1).bit_length())


# --- Spark ----------------------------------------------------------------------------------------------------
def _block(depth: int) -> Column:
    return F.shiftright("idx", depth)


def climb(nodes: DataFrame, depth: int) -> DataFrame:
    """(tree, idx, path, root) of nodes (tree, idx, n, digest): their steps to the root, round by round."""
    most = nodes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if most <= 1:
        return nodes.select("tree", "idx", F.expr("X''").alias("path"), F.col("digest").alias("root"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        block = Block(from_bytes(rows.column("digest").to_pylist()), _levels(rows.column("n")[0].as_py(), depth))
        n = rows.num_rows
        return pa.table({"tree": rows.column("tree"), "idx": rows.column("idx"), "n": rows.column("n"), "path": paths(block, np.arange(n)),
                         "top": pa.array([*to_bytes(block.root), *[None] * (n - 1)], pa.binary())})

    found = cut_lineage(nodes.groupBy("tree", _block(depth).alias("__block")).applyInArrow(run, "tree string, idx long, n long, path binary, top binary"))
    above = climb(tops_of(found, depth), depth).withColumnsRenamed({"idx": "__block", "path": "__above"})
    return (found.withColumn("__block", _block(depth)).join(above, ["tree", "__block"])
            .select("tree", "idx", F.concat("path", "__above").alias("path"), "root"))


def tops_of(blocks: DataFrame, depth: int) -> DataFrame:
    """The roots of blocks as nodes of the next round."""
    return blocks.filter(F.col("top").isNotNull()).select(
        "tree", _block(depth).alias("idx"), F.ceil(F.col("n") / (1 << depth)).cast("long").alias("n"), F.col("top").alias("digest"))


def digest_of(docs: DataFrame, fields: Sequence[str], changed: dict[str, Column] | None = None) -> Column:
    """The leaf of a row, 32 bytes; ``changed`` gives fields another value."""
    def written(name: str) -> Column:
        text = (changed or {}).get(name, col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[written(c) for c in fields]).cast("binary"), 256))


def fold_all(docs: DataFrame, replaced: Column | None = None, key: str = "doc_id", group: str = "lang",
             fields: Sequence[str] = FIELDS, with_paths: bool = False, depth: int = DEPTH) -> DataFrame:
    """The manifest: (key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, digests in hexadecimal.

    ``replaced`` is the digest a row has now (its own by default; null: unchanged), which is folded to ``folded_root``.
    ``with_paths`` adds the steps from the leaf to the root, as ``follow`` takes them."""
    leaf = digest_of(docs, fields)
    tree = F.coalesce(F.concat(F.lit("="), col(group).cast("string")), F.lit(""))      # null first, then by bytes
    leaves = cut_lineage(docs.select(col(key).alias("key"), tree.alias("tree"), leaf.alias("leaf"), (leaf if replaced is None else replaced).alias("now")))
    kind = leaves.schema["key"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        n, leaf_bytes = rows.num_rows, rows.column("leaf").to_pylist()
        block = Block(from_bytes(leaf_bytes), _levels(rows.column("n")[0].as_py(), depth))
        value = from_bytes([now or own for now, own in zip(rows.column("now").to_pylist(), leaf_bytes)])
        proof, count = started(n), np.zeros(n, np.int64)
        for step in block.steps(np.arange(n)):
            value = fold_step(value, *step)
            proof, count = proof_step(proof, count, step[0], step[2])
        return pa.table({"key": rows.column("key"), "tree": rows.column("tree"), "idx": rows.column("idx"), "n": rows.column("n"),
                         "leaf": rows.column("leaf"), "folded": to_bytes(value), "proof": to_bytes(proof), "count": count,
                         "path": pa.array(paths(block, np.arange(n)) if with_paths else [None] * n, pa.binary()),
                         "top": pa.array([*to_bytes(block.root), *[None] * (n - 1)], pa.binary())})

    found = cut_lineage(numbered(leaves, "tree", ["key", "leaf"]).groupBy("tree", _block(depth).alias("__block")).applyInArrow(
        run, f"key {kind}, tree string, idx long, n long, leaf binary, folded binary, proof binary, count long, path binary, top binary"))
    trees = cut_lineage(climb(tops_of(found, depth), depth))
    subroots = trees.filter("idx = 0").select(F.lit("").alias("one"), F.col("tree").alias("of"), F.col("root").alias("digest"))
    ranked = cut_lineage(numbered(subroots, "one", ["of"]))
    tops = climb(ranked.select(F.col("one").alias("tree"), "idx", "n", "digest"), depth).select("idx", F.col("path").alias("__last"), F.col("root").alias("whole"))
    last = small_side(ranked.select("idx", F.col("of").alias("tree")).join(tops, "idx").drop("idx"))
    upper = trees.join(last, "tree").select("tree", F.col("idx").alias("__block"), F.concat("path", "__last").alias("above"),
                                            F.col("root").alias("subroot"), F.col("whole").alias("root"))
    joined = found.drop("n", "top").withColumn("__block", _block(depth)).join(upper, ["tree", "__block"]).drop("tree", "__block", "idx")
    hexed = lambda name: F.lower(F.hex(name)).alias(name)
    done = joined.mapInArrow(_finish, f"key {kind}, leaf binary, subroot binary, root binary, proof_sha256 binary, folded_root binary, path binary, above binary")
    extra = [F.concat("path", "above").alias("path")] if with_paths else []
    return done.select(F.col("key").alias(key), hexed("leaf"), hexed("subroot"), hexed("root"), hexed("proof_sha256"), hexed("folded_root"),
                       (F.col("folded_root") == F.col("root")).alias("verified"), *extra)


def _finish(batches):
    """Fold what stands above the blocks, many rows at a time."""
    names = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "path", "above"]

    def run(waiting: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        rows = pa.Table.from_batches(waiting)
        above, folded = rows.column("above").to_pylist(), rows.column("folded").to_pylist()
        known = {p: i for i, p in enumerate(dict.fromkeys(above))}
        own = np.array([known[p] for p in above])
        proof, count = from_bytes(rows.column("proof").to_pylist()), rows.column("count").to_numpy().copy()
        pairs = {pair: i for i, pair in enumerate(dict.fromkeys(zip(own.tolist(), folded)))}   # unchanged rows of a block fold alike
        which = np.array([pairs[pair] for pair in zip(own.tolist(), folded)])
        of, value = np.array([p for p, _ in pairs]), from_bytes([f for _, f in pairs])
        lengths = np.array([len(p) // STEP for p in known])
        for level in range(int(lengths.max(initial=0))):
            there = lengths > level
            steps = [p[level * STEP:(level + 1) * STEP].ljust(STEP, b"\0") for p in known]
            kind = np.array([s[0] for s in steps])
            state, other = from_bytes([s[1:33] for s in steps]), from_bytes([s[33:] for s in steps])
            at = np.flatnonzero(there[of])
            value[:, at] = fold_step(value[:, at], kind[of[at]], state[:, of[at]], other[:, of[at]])
            at = np.flatnonzero(there[own])
            proof[:, at], count[at] = proof_step(proof[:, at], count[at], kind[own[at]], other[:, own[at]])
        columns = [rows.column(c) for c in names[:4]] + [pa.chunked_array([pa.array(x, pa.binary())]) for x in (
            to_bytes(finish_each(proof, count)), to_bytes(value[:, which]))] + [rows.column(c) for c in names[6:]]
        return pa.Table.from_arrays(columns, names).to_batches()

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= FOLD_ROWS:
            yield from run(waiting)
            waiting = []
    if waiting:
        yield from run(waiting)


def tampered(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", number: str = "n_chars", divisor: int = 7) -> Column:
    """The digest of rows whose key's checksum the divisor divides with one more character counted; null for all others."""
    chosen = F.pmod(F.crc32(col(key).cast("string").cast("binary")), F.lit(divisor)) == 0
    return F.when(chosen, digest_of(docs, fields, {number: col(number).cast("decimal(38,0)") + 1}))


def _sql_digest(number: str) -> str:
    """The leaf in SQL, with the number of characters given."""
    parts = [f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
             for c in ("doc_id", "source", "lang", number, "text")]
    return f"sha256({' || '.join(parts)})"


_SQL_BYTE = "list_reduce(list_prepend(xor(c, b), range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
_SQL_CRC = (f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), "
            f"[CAST(ord(x) AS BIGINT) for x in string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: {_SQL_BYTE}))")


def _sql_folds(name: str, nodes: str, base: str, on: str, extra: str) -> str:
    """Folds of every row from its node to the top of its tree, level by level."""
    return f"""{name} AS ({base} UNION ALL
        SELECT f.rid, {extra} f.idx // 2, (f.n + 1) // 2, f.level + 1,
            sha256(CASE WHEN s.digest IS NULL THEN f.value WHEN f.idx % 2 = 0 THEN f.value || s.digest ELSE s.digest || f.value END),
            f.proof || coalesce(s.digest, '')
        FROM {name} AS f LEFT JOIN {nodes} AS s ON {on} s.level = f.level AND s.idx = xor(f.idx, 1) WHERE f.n > 1)"""


SQL = f"""
    WITH RECURSIVE leaves AS (
        SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS tree, {_sql_digest("n_chars")} AS leaf,
            CASE WHEN doc_id IS NOT NULL AND {_SQL_CRC} % 7 = 0 THEN {_sql_digest("(n_chars + 1)")} ELSE {_sql_digest("n_chars")} END AS now
        FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
    nodes AS (SELECT tree, 0 AS level, idx, n, leaf AS digest FROM placed UNION ALL
        SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 2, n),
    subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
    tops AS (SELECT 0 AS level, idx, n, digest FROM subroots UNION ALL
        SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 2, n),
    {_sql_folds("inner_folds", "nodes", "SELECT rid, tree, idx, n, 0 AS level, now AS value, '' AS proof FROM placed", "s.tree = f.tree AND", "f.tree,")},
    {_sql_folds("outer_folds", "tops", "SELECT f.rid, r.idx, r.n, 0 AS level, f.value, f.proof FROM inner_folds AS f JOIN subroots AS r ON r.tree = f.tree WHERE f.n = 1", "", "")}
    SELECT p.doc_id, p.leaf, r.digest AS subroot, t.digest AS root, sha256(f.proof) AS proof_sha256, f.value AS folded_root, f.value = t.digest AS verified
    FROM placed AS p JOIN outer_folds AS f ON f.rid = p.rid AND f.n = 1 JOIN subroots AS r ON r.tree = p.tree JOIN tops AS t ON t.n = 1"""


@BOOK.add("op13_merkle_manifest", SQL)
def merkle_manifest(spark, sf_dir):
    """Leaf, subroot, root and proof of every document, and the root that its tampered leaf folds to."""
    docs = table(spark, sf_dir, "documents")
    return fold_all(docs, tampered(docs))
