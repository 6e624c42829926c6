"""N-gram Jaccard join: rare-first prefix filtering on word shingles, each candidate pair verified once.

1. Every document becomes the set of the 64-bit hashes of its shingles; documents with equal sets are one
   node from here on. Nodes keep only what others have too: the shingle hashes of blocks of documents
   are dealt by value, in packed arrays, and those found in two or more sets come back to their nodes
   with their frequency. No intersection holds any other shingle. A shingle that many sets of a block have is
   one entry of the block, however many these are.
2. A node's prefix is its n - ceil(t n) + 1 rarest shingles. Shingles of its own come first, so most
   documents have nothing in their prefix that another one has, and leave.
3. Nodes that share a prefix shingle are candidates, if the length and positional filters let them pass.
   First each node is tried against one leader among its candidates, a few times over, and links join
   nodes into components. Only then all candidates that are still in different components are tried:
   nodes are gathered in blocks by their leaders, and each two blocks that share a prefix shingle are
   joined once, by the same prefixes and filters, so that a large group of copies gives a few rows of blocks
   and not the square of pairs.
4. A pair that passes the suffix filter is verified on the shared shingles of both, once: pairs tried with a leader
   are known to the blocks.

Defined cases: null, empty and blank text has the empty set and is linked with nothing; rows with a null id
get their size and a null component; rows with one id are one document for the links; repeated rows
each give a row; an empty table gives no rows; further columns are ignored; texts of any length are
whole; shorter texts than a shingle are one shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_schema, dealt, groups_for, id_type, keyed_text, parted_batch, slices, stored, tidy
from .components import components
from .hashing import mix, shingle_hashes, word_hashes

CHUNK, BLOCK = 1 << 20, 8 << 20
GROUP_BYTES = 8 << 20  # of text for each bucket of shingles and each home of nodes
LEADER_ROUNDS = 2
BLOCK_NODES, BLOCK_BYTES = 512, 1 << 20  # of nodes and of their shared shingles in a block
SUFFIX_DEPTH = 3
COMMON = 16  # sets of a block from which a shingle is counted for all of them at once
_LOW = np.uint64((1 << 40) - 1)


def _sets(column: pa.Array, k: int):
    """For the texts of a column: all distinct shingle hashes, their bounds, and the nodes."""
    hashes, ends = shingle_hashes(*word_hashes(column), k)
    sets = [np.unique(hashes[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat), dtype=np.uint64)))
    bounds = np.concatenate(([0], np.cumsum(n)))
    return flat, bounds, mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64)).view(np.int64)


def document_sets(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, node) for every row."""
    kind = id_type(docs, id_col)
    schema = f"id {kind}, n bigint, node bigint"
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(1), CHUNK):
                _, bounds, node = _sets(batch.column(1).slice(i, j - i), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(node)], schema=arrow)

    return keyed_text(docs, id_col, text_col).mapInArrow(tidy(run), schema)


def _planes(x: np.ndarray) -> bytes:
    """40-bit integers as 5 bytes each."""
    return (x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (x >> np.uint64(32)).astype(np.uint8).tobytes()


def _unplane(b: bytes) -> np.ndarray:
    n = len(b) // 5
    return np.frombuffer(b, "<u4", n).astype(np.uint64) | np.frombuffer(b, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)


def _token(low: np.ndarray, bucket, grade: np.ndarray) -> np.ndarray:
    """Tokens of shingles, ordered by frequency first; positive as signed integers."""
    return mix(low + (np.uint64(bucket) << np.uint64(40) if isinstance(bucket, int) else bucket << np.uint64(40))) >> np.uint64(9) | grade.astype(np.uint64) << np.uint64(55)


def shared_shingles(docs: DataFrame, k: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(node, n, own, prefix, shared): the nodes whose prefix holds a shingle that another node has; ``shared`` are
    all such shingles of it as tokens in ascending order, which is from rare to frequent, ``own`` the number of the others,
    ``prefix`` how many of ``shared`` belong to the prefix. Stored."""
    parts = groups_for(docs, text_col, GROUP_BYTES)
    block_schema = "bucket int, block bigint, nodes binary, sizes binary, counts binary, hashes binary, often binary, often_counts binary, often_buckets binary, members binary"
    arrow = arrow_schema(block_schema)

    def blocks(batches):
        from pyspark import TaskContext

        held: list = []
        size, block = 0, TaskContext.get().partitionId() << 32

        def flush():
            flat = np.concatenate([f for f, _, _ in held])
            node = np.concatenate([x for _, _, x in held])
            n = np.concatenate([np.diff(b) for _, b, _ in held])
            node, first = np.unique(node, return_index=True) if len(node) else (node, np.zeros(0, np.int64))
            starts = np.cumsum(n) - n
            n, starts = n[first], starts[first]
            at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
            flat, owner = flat[at], np.repeat(np.arange(len(node)), n)
            order = np.argsort(flat, kind="stable")
            new = np.concatenate(([True], flat[order][1:] != flat[order][:-1])) if len(flat) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(flat)))
            common = np.repeat(count >= COMMON, count)
            # a shingle that many sets of the block have is one entry with their number; who they are stays with the block
            often, often_count, members = flat[order[first]][count >= COMMON], count[count >= COMMON], owner[order[common]]
            flat, owner = flat[order[~common]], owner[order[~common]]
            often_bucket = ((often >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
            by = np.argsort(often_bucket, kind="stable")
            begin = np.cumsum(often_count) - often_count
            members = members[np.repeat(begin[by] - (np.cumsum(often_count[by]) - often_count[by]), often_count[by]) + np.arange(len(members))]
            often, often_count, often_bucket = often[by], often_count[by], often_bucket[by]
            rows: list[list] = [[] for _ in arrow.names]

            def add(**x):
                for column, name in zip(rows, arrow.names):
                    column.append(x.get(name))

            bucket = ((flat >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((owner, bucket))
            ends = np.searchsorted(bucket[order], np.arange(parts + 1))
            often_ends = np.searchsorted(often_bucket, np.arange(parts + 1))
            for b in np.flatnonzero((np.diff(ends) > 0) | (np.diff(often_ends) > 0)).tolist():
                mine, some = order[ends[b] : ends[b + 1]], slice(often_ends[b], often_ends[b + 1])
                who, count = np.unique(owner[mine], return_counts=True)
                add(bucket=b, block=block, nodes=node[who].tobytes(), sizes=n[who].tobytes(), counts=count.astype(np.int32).tobytes(), hashes=_planes(flat[mine] & _LOW), often=_planes(often[some] & _LOW), often_counts=often_count[some].astype(np.int32).tobytes())
            if len(often):
                add(bucket=int(block % parts), block=block, nodes=node.tobytes(), sizes=n.tobytes(), often=_planes(often & _LOW), often_counts=often_count.astype(np.int32).tobytes(), often_buckets=often_bucket.tobytes(), members=members.astype(np.int32).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, arrow)], schema=arrow)

        for batch in batches:
            for i, j in slices(batch.column(1), CHUNK):
                part = batch.column(1).slice(i, j - i)
                held.append(_sets(part, k))
                size += part.nbytes
                if size >= BLOCK:
                    yield from parted_batch(flush())
                    held, size, block = [], 0, block + 1
        if held:
            yield from parted_batch(flush())

    # rows with a home go there; of the others, those with members are the blocks' own, and the rest the grades for these
    reply_schema = "home int, block bigint, bucket int, nodes binary, sizes binary, counts binary, tokens binary, grades binary, often binary, often_buckets binary, members binary"
    reply_arrow = arrow_schema(reply_schema)

    def read(table: pa.Table, column: str, kind) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *(np.frombuffer(b, kind) for b in table.column(column).to_pylist() if b is not None)])

    def hashes(table: pa.Table, column: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(_unplane(b) for b in table.column(column).to_pylist() if b is not None)])

    def to_homes(add, node: np.ndarray, size: np.ndarray, token: np.ndarray) -> None:
        home = (node.view(np.uint64) % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((node, home))
        ends = np.searchsorted(home[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(ends)).tolist():
            mine = order[ends[p] : ends[p + 1]]
            who, at, count = np.unique(node[mine], return_index=True, return_counts=True)
            add(home=p, nodes=who.tobytes(), sizes=size[mine][at].tobytes(), counts=count.astype(np.int32).tobytes(), tokens=token[mine].tobytes())

    def frequencies(table: pa.Table) -> pa.Table:
        rows: list[list] = [[] for _ in reply_arrow.names]

        def add(**x):
            for column, name in zip(rows, reply_arrow.names):
                column.append(x.get(name))

        for row in table.filter(pc.is_valid(table.column("members"))).to_pylist():
            add(block=row["block"], nodes=row["nodes"], sizes=row["sizes"], counts=row["often_counts"], often=row["often"], often_buckets=row["often_buckets"], members=row["members"])
        table = table.filter(pc.is_null(table.column("members")))
        if len(table):
            bucket = table.column("bucket")[0].as_py()
            count = read(table, "counts", np.int32)
            node, size = np.repeat(read(table, "nodes", np.int64), count), np.repeat(read(table, "sizes", np.int64), count)
            h = hashes(table, "hashes")
            often, often_count = hashes(table, "often"), read(table, "often_counts", np.int32)
            order = np.argsort(h, kind="stable")
            hs = h[order]
            same = np.concatenate(([False], hs[1:] == hs[:-1]))[: len(hs)]
            twice = same | np.concatenate((same[1:], [False]))[: len(hs)]
            twice |= np.isin(hs, often)
            order = order[twice]  # only values met more than once need the exact order by node
            h, node, size = h[order], node[order], size[order]
            order = np.lexsort((node, h))
            h, node, size = h[order], node[order], size[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
            h, node, size = h[new], node[new], size[new]
            # all values with the number of sets that have them, once a block where many of a block do
            value, back = np.unique(np.concatenate((h, often)), return_inverse=True)
            df = np.bincount(back, np.concatenate((np.ones(len(h)), often_count)), minlength=len(value))
            grade = np.minimum(255, np.round(6 * np.log2(np.maximum(df, 1)))).astype(np.uint8)[back]
            own, often_grade = grade[: len(h)], grade[len(h) :]
            shared = df[back[: len(h)]] > 1
            to_homes(add, node[shared], size[shared], _token(h[shared], bucket, own[shared]))
            at = 0
            for block, b in zip(table.column("block").to_pylist(), table.column("often").to_pylist()):
                if m := len(b) // 5:
                    add(block=block, bucket=bucket, grades=often_grade[at : at + m].tobytes())
                    at += m
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(rows, reply_arrow)], schema=reply_arrow)

    def expand(table: pa.Table) -> pa.Table:
        """The tokens of a block's own sets, from the grades that came back for its shingles, bucket by bucket."""
        rows: list[list] = [[] for _ in reply_arrow.names]

        def add(**x):
            for column, name in zip(rows, reply_arrow.names):
                column.append(x.get(name))

        mine = table.filter(pc.is_valid(table.column("members")))
        if len(mine):
            grade = read(table.filter(pc.is_valid(table.column("grades"))).sort_by("bucket"), "grades", np.uint8)
            count, member = read(mine, "counts", np.int32), read(mine, "members", np.int32)
            token = np.repeat(_token(hashes(mine, "often"), read(mine, "often_buckets", np.int32).astype(np.uint64), grade), count)
            to_homes(add, read(mine, "nodes", np.int64)[member], read(mine, "sizes", np.int64)[member], token)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(rows, reply_arrow)], schema=reply_arrow)

    out_schema = "node bigint, n bigint, own bigint, prefix int, shared binary"
    out_arrow = arrow_schema(out_schema)

    def gather(table: pa.Table) -> pa.Table:
        count = read(table, "counts", np.int32)
        node, size, h = np.repeat(read(table, "nodes", np.int64), count), np.repeat(read(table, "sizes", np.int64), count), read(table, "tokens", np.uint64)
        order = np.lexsort((h, node))
        node, size, h = node[order], size[order], h[order]
        new = np.concatenate(([True], (node[1:] != node[:-1]) | (h[1:] != h[:-1])))  # a set in several blocks has its tokens once
        node, size, h = node[new], size[new], h[new]
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        ends = np.append(first, len(node))
        n = size[first]
        own = n - np.diff(ends)
        prefix = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1 - own
        rows = [i for i in range(len(first)) if prefix[i] > 0]
        shared = [h[ends[i] : ends[i + 1]].tobytes() for i in rows]
        return pa.Table.from_arrays([pa.array(node[first][rows]), pa.array(n[rows]), pa.array(own[rows]), pa.array(prefix[rows].astype(np.int32)), pa.array(shared, pa.binary())], schema=out_arrow)

    entries = keyed_text(docs, id_col, text_col).mapInArrow(tidy(blocks), block_schema)
    replies = stored(dealt(entries, "bucket", parts).groupBy("bucket").applyInArrow(tidy(frequencies), reply_schema), "replies")
    from_blocks = dealt(replies.where("home IS NULL"), "block", parts).groupBy("block").applyInArrow(tidy(expand), reply_schema)
    by_home = replies.where("home IS NOT NULL").unionByName(from_blocks).select("home", "nodes", "sizes", "counts", "tokens")
    return stored(dealt(by_home, "home", parts).groupBy("home").applyInArrow(tidy(gather), out_schema), "shared")


def _prefixes(shared: DataFrame) -> DataFrame:
    """(token, node, n, at): the prefix entries; ``at`` is the place in the whole sorted set, from 0."""
    schema = "token bigint, node bigint, n bigint, at bigint"
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            node, n, own, prefix = (np.asarray(batch.column(i)) for i in range(4))
            tokens = [np.frombuffer(b, np.int64, p) for b, p in zip(batch.column(4).to_pylist(), prefix.tolist())]
            total = int(prefix.sum())
            at = np.arange(total) - np.repeat(np.cumsum(prefix) - prefix, prefix) + np.repeat(own, prefix)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *tokens])), pa.array(np.repeat(node, prefix)), pa.array(np.repeat(n, prefix)), pa.array(at)], schema=arrow)

    return shared.mapInArrow(run, schema)


def _possible(threshold: float):
    """The length filter and the positional filter on columns n, at of one side and m, to of the other."""
    n, m, at, to = map(F.col, ("n", "m", "at", "to"))
    need = F.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)
    return (F.least(n, m) >= F.greatest(n, m) * threshold - 1e-9) & (F.least(at, to) + F.least(n - at, m - to) >= need)


def most_in_common(x: np.ndarray, y: np.ndarray, depth: int = SUFFIX_DEPTH) -> int:
    """An upper bound of what two ascending arrays have in common, by splitting both at the middle token of the second."""
    if not depth or len(x) < 2 or len(y) < 2:
        return min(len(x), len(y))
    k = len(y) // 2
    i = int(np.searchsorted(x, y[k]))
    met = int(i < len(x) and x[i] == y[k])
    return most_in_common(x[:i], y[:k], depth - 1) + met + most_in_common(x[i + met :], y[k + 1 :], depth - 1)


def similar(x: np.ndarray, y: np.ndarray, n: int, m: int, at: int, to: int, threshold: float) -> bool:
    """Whether two sets of sizes n and m, with shared tokens x and y, are as similar as the threshold. At their first common
    token, x[at] and y[to], the positional filter bounds what can follow by what is left, the suffix filter by halves of it."""
    need = int(np.ceil((n + m) * threshold / (1 + threshold) - 1e-9))
    x, y = x[at + 1 :], y[to + 1 :]
    if 1 + min(len(x), len(y)) < need or 1 + most_in_common(x, y) < need:
        return False
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    found = np.searchsorted(y, x)
    return 1 + int((y[np.minimum(found, len(y) - 1)] == x).sum()) >= need if len(y) else need <= 1


def _first_common(x: np.ndarray, y: np.ndarray) -> tuple[int, int] | None:
    i = np.searchsorted(x, y)
    met = np.flatnonzero(x[np.minimum(i, len(x) - 1)] == y)
    return (int(i[met[0]]), int(met[0])) if len(met) else None


def _verified(pairs: DataFrame, shared: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold."""
    side = lambda x: shared.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("shared").alias(f"s_{x}"))
    schema = "a bigint, b bigint"
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            keep = []
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("n_a", "n_b", "s_a", "s_b")]
            for i in range(len(batch)):
                n, m, x, y = (c[i].as_py() for c in cols)
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                first = _first_common(x, y)
                if first and similar(x, y, n, m, *first, threshold):
                    keep.append(i)
            rows = batch.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(c)) for c in ("a", "b")], schema=arrow)

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(tidy(run), schema)


_PACK = "block bigint, nodes binary, roots binary, sizes binary, prefixes binary, counts binary, tokens binary, tried binary, tries binary"


def _packed(table: pa.Table, arrow: pa.Schema) -> pa.Table:
    """A block as one row: of its nodes the names, roots, sizes, prefix lengths, shared tokens and pairs tried before."""
    one = lambda c, kind: np.asarray(table.column(c), kind).tobytes()
    shared = table.column("shared").to_pylist()
    tried = [t or [] for t in table.column("tried").to_pylist()]
    row = [
        table.column("block")[0].as_py(), one("node", np.int64), one("root", np.int64), one("n", np.int64), one("prefix", np.int32),
        np.array([len(b) // 8 for b in shared], np.int32).tobytes(), b"".join(shared), np.array([o for t in tried for o in t], np.int64).tobytes(), np.array([len(t) for t in tried], np.int32).tobytes(),
    ]
    return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)


class Pack:
    """The nodes of a packed block, and the places of tokens in their prefixes."""

    def __init__(self, row: dict, side: str):
        part = lambda c, kind: np.frombuffer(row[f"{c}_{side}"], kind)
        self.nodes, self.roots, self.sizes = (part(c, np.int64) for c in ("nodes", "roots", "sizes"))
        self.prefixes, count = part("prefixes", np.int32).astype(np.int64), part("counts", np.int32).astype(np.int64)
        self.tokens = part("tokens", np.int64)
        self.ends = np.cumsum(count)
        self.starts = self.ends - count
        tried, tries = part("tried", np.int64), part("tries", np.int32)
        self.tried = set(zip(np.repeat(self.nodes, tries).tolist(), tried.tolist()))

    def set(self, i: int) -> np.ndarray:
        return self.tokens[self.starts[i] : self.ends[i]]

    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of the prefixes in order, the nodes that they are from, and their places."""
        p = self.prefixes
        owner = np.repeat(np.arange(len(p)), p)
        place = np.arange(int(p.sum())) - np.repeat(np.cumsum(p) - p, p)
        token = self.tokens[np.repeat(self.starts, p) + place]
        order = np.lexsort((place, token))
        return token[order], owner[order], place[order]


def _compared(left: Pack, right: Pack, same: bool, threshold: float):
    """Links (a, b) between nodes of two blocks that are in different components so far."""
    parent: dict[int, int] = {}

    def find(r: int) -> int:
        while parent.setdefault(r, r) != r:
            r = parent[r]
        return r

    token, owner, place = right.index()
    for i in range(len(left.nodes)):
        x, n = left.set(i), int(left.sizes[i])
        own = x[: left.prefixes[i]]
        lo, hi = np.searchsorted(token, own), np.searchsorted(token, own, "right")
        size = hi - lo
        if not size.any():
            continue
        hits = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        j, first = np.unique(owner[hits], return_index=True)  # own tokens ascend, so the first hit is the first common token
        at, to = np.repeat(np.arange(len(own)), size)[first], place[hits[first]]
        m = right.sizes[j]
        least = np.maximum(n, m)
        need = np.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)
        left_over = np.minimum(len(x) - at, (right.ends - right.starts)[j] - to)
        ok = (np.minimum(n, m) >= least * threshold - 1e-9) & (left_over >= need)
        if same:
            ok &= j > i
        name = int(left.nodes[i])
        for k in np.flatnonzero(ok).tolist():
            other = int(right.nodes[j[k]])
            r, q = find(int(left.roots[i])), find(int(right.roots[j[k]]))
            if r == q or (name, other) in left.tried or (other, name) in right.tried:
                continue
            if similar(x, right.set(int(j[k])), n, int(m[k]), int(at[k]), int(to[k]), threshold):
                parent[max(r, q)] = min(r, q)
                yield name, other


def _blocks_compared(entries: DataFrame, shared: DataFrame, tried: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join the components of the nodes of ``entries``; ``tried`` are pairs (node, other) verified before."""
    # nodes take the smallest mark that goes round among their tokens' nodes, so that groups have few marks
    marked = entries.select("token", "node", "root", F.xxhash64("node").alias("lead"))
    for _ in range(2):
        by_token = marked.groupBy("token").agg(F.min("lead").alias("_l"))
        by_node = marked.join(by_token, "token").groupBy("node", "root").agg(F.min("_l").alias("lead"))
        marked = stored(marked.select("token", "node").join(by_node, "node"), "marked")
    nodes = marked.select("node", "root", "lead").distinct().join(shared.select("node", F.length("shared").alias("bytes")), "node")
    sizes = nodes.groupBy("lead").agg(F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum("bytes") / BLOCK_BYTES)).alias("k"))
    placed = stored(nodes.join(sizes, "lead").select("node", "root", F.xxhash64("lead", F.pmod(F.xxhash64("node"), "k")).alias("block")), "blocks")
    # tokens of one set of blocks ask for the same pairs
    met = entries.select("token", "node").join(placed.select("node", "block"), "node").groupBy("token").agg(F.sort_array(F.collect_set("block")).alias("met")).select("met").distinct()
    pairs = met.select(F.posexplode("met").alias("i", "x"), "met").select("x", F.explode(F.slice("met", F.col("i") + 1, F.size("met"))).alias("y")).distinct()
    others = tried.groupBy("node").agg(F.collect_set("other").alias("tried"))  # one a leader round
    rows = placed.join(shared, "node").join(others, "node", "left").select("block", "node", "root", "n", "prefix", "shared", "tried")
    pack_arrow = arrow_schema(_PACK)
    packs = stored(rows.groupBy("block").applyInArrow(tidy(lambda table: _packed(table, pack_arrow)), _PACK), "packs")
    side = lambda x: packs.select(F.col("block").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in packs.columns[1:]))
    arrow = arrow_schema("a bigint, b bigint")

    def compare(table: pa.Table) -> pa.Table:
        found = [link for row in table.to_pylist() for link in _compared(Pack(row, "x"), Pack(row, "y"), row["x"] == row["y"], threshold)]
        return pa.Table.from_arrays([pa.array([link[k] for link in found], pa.int64()) for k in (0, 1)], schema=arrow)

    return pairs.join(side("x"), "x").join(side("y"), "y").groupBy("x", "y").applyInArrow(tidy(compare), "a bigint, b bigint")


def links(shared: DataFrame, threshold: float, rounds: int = LEADER_ROUNDS) -> DataFrame:
    """(node, root) for each linked node."""
    spark = shared.sparkSession
    prefix = stored(_prefixes(shared), "prefix")
    found = None
    roots = spark.createDataFrame([], "node bigint, root bigint")

    def rooted() -> DataFrame:
        """Entries of the tokens that nodes of different components share."""
        p = prefix.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = p.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("token")
        return stored(p.join(mixed, "token", "left_semi"), "entries")

    def linked(new: DataFrame) -> bool:
        nonlocal found, roots
        new = stored(new, "links")
        if new.isEmpty():
            return False
        found = new if found is None else found.union(new)
        roots = components(found)
        return True

    entries, tried, asked = rooted(), None, spark.createDataFrame([], "node bigint, other bigint")
    for r in range(rounds):
        if entries.isEmpty():
            return roots
        turn = F.xxhash64("node", F.lit(r))
        leaders = entries.groupBy("token").agg(F.min_by(F.struct(F.col("node").alias("other"), F.col("n").alias("m"), F.col("at").alias("to"), F.col("root").alias("its")), turn).alias("l")).select("token", "l.*")
        met = entries.join(leaders, "token").where((F.col("root") != F.col("its")) & _possible(threshold))
        best = stored(met.groupBy("node", "other").agg(F.count("*").alias("c")).groupBy("node").agg(F.max_by("other", F.struct("c", "other")).alias("other")), "best")
        pairs = best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        asked = asked.union(best)
        more = linked(_verified(pairs, shared, threshold))
        entries = rooted() if more else entries
        if not more:
            break
    if not entries.isEmpty():
        linked(_blocks_compared(entries, shared, asked, threshold))
    return roots


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): one row per row of ``docs``."""
    rows = stored(document_sets(docs, k, id_col, text_col), "sets")
    roots = links(shared_shingles(docs, k, threshold, id_col, text_col), threshold)
    full = rows.where("n > 0 AND id IS NOT NULL")
    # rows with one id are one document: their nodes belong together
    several = full.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    same_id = full.join(several.select("id", "a"), "id").select("a", F.col("node").alias("b"))
    classes = full.select("id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if not several.isEmpty():
        joined = components(same_id.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        classes = full.select("id", "node").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_node = classes.select("node", "root", "id").groupBy("node", "root").agg(F.min("id").alias("id"))
    least = by_node.groupBy("root").agg(F.min("id").alias("component_id"))
    named = by_node.select("node", "root").join(least, "root").select("node", "component_id")
    out = rows.join(named, "node", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).alias("c"))
    return out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, without those whose component has a smaller id; of rows with one id the
    one with the smallest text, equal ones by a hash of their columns. Rows with a null id stay."""
    found = near_duplicates(docs, k, threshold, id_col, text_col)
    kept = stored(found.where("id = component_id").groupBy("id").agg(F.count("*").alias("rows")), "kept")
    named = docs.where(F.col(id_col).isNotNull())
    # the ids that stay grow with the documents, so they are joined by a shuffle at every size, not broadcast
    out = named.join(kept.select(F.col("id").alias(id_col)).hint("merge"), id_col, "left_semi").select(*docs.columns)
    if not kept.where("rows > 1").isEmpty():
        row, order = F.struct(*docs.columns), F.struct(F.coalesce(text_col, F.lit("")), F.xxhash64(*docs.columns))
        out = out.groupBy(F.col(id_col).alias("_key")).agg(F.min_by(row, order).alias("_row")).select("_row.*")
    return out.unionByName(docs.where(F.col(id_col).isNull()))


def op1(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).withColumnRenamed("id", "doc_id")
