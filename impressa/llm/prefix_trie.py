"""Prefix trie of rebuilt conversations, by a splitter skeleton.

Every conversation becomes one path: a fixed-width symbol per turn (128 bits of
SHA-256 of role and text) in turn order, so that a trie node is a run of
neighbours in the order of paths.  The paths are cut into ranges (shards).  A
node that reaches over a cut is a prefix of the splitter paths on both sides;
all such nodes form the skeleton.  It is known from two integers a shard: how
many symbols its first and last path share, and how many its last path shares
with the next shard's first.  These integers are what is broadcast, so its
size does not depend on the length of the paths.

* Each task walks its sorted shard once with a stack of open nodes and
  finishes every node that is not in the skeleton.
* For a skeleton node it gives a partial row (members, children that begin
  here, leaves and savings of finished nodes below); a sum over shards reduces
  these.
* Skeleton nodes hang together in chains, one for each cut at which nodes
  begin.  Sums below a node are sums along its chain plus those of chains
  attached to it; the driver sees one total a cut.
* The digest of members that end in a skeleton node is taken over packed id
  lists, one row a shard and list, in order, in a stream.

A conversation itself is one row: 32 characters and a length for each turn,
never its texts.

Defined results: rows with null ``conv_id`` belong to no conversation and are
left out.  Null role or text is empty.  Rows are ordered by turn (null
first), then role, then text; repeated rows are turns of their own.  ``c % 100`` keeps the
sign of ``c`` as in SQL.  No conversation gives no node.  Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from impressa.operators.ordering import RANGE, cut_ranges
from impressa.sources.sinks import stage

SYMBOL = 32
HEAD = 5
GROUP = 100
IDS_A_ROW = 1 << 16

_ROW = pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("owner", pa.int64()), ("depth", pa.int64()),
                  ("conv_id", pa.int64()), ("parent_owner", pa.int64()), ("parent_conv_id", pa.int64()),
                  ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                  ("saved_tokens", pa.int64()), ("last_chars", pa.int64()), ("ends_sha256", pa.string()),
                  ("part", pa.int64()), ("ids", pa.binary())])
_DDL = ("kind string, shard long, owner long, depth long, conv_id long, parent_owner long, parent_conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, last_chars long, ends_sha256 string, part long, ids binary")
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, turns: (i, sym, chars) of every turn, in order."""
    t = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sym = F.left(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), F.lit(SYMBOL))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.select("conv_id", F.row_number().over(w).alias("i"), sym.alias("sym"), F.length("text").alias("chars"))
    return t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "sym", "chars"))).alias("turns"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """conv_id, path, chars: the conversation's head comes from the first one of its hundred."""
    own = stage(turns_of(rows), "trie-turns")
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = (own.where(F.col("conv_id") % GROUP == 0)
             .select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEAD).alias("head")))
    none = F.slice("turns", 1, 0)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    return (own.withColumn("base", base).join(heads, "base", "left").select("conv_id", turns.alias("turns"))
            .select("conv_id", F.array_join(F.transform("turns", lambda t: t["sym"]), "").alias("path"),
                    F.transform("turns", lambda t: t["chars"]).alias("chars")))


def _shared(a: str, b: str) -> int:
    """Symbols that two paths have in common from the start."""
    n = min(len(a), len(b)) // SYMBOL
    for d in range(n):
        if a[d * SYMBOL:(d + 1) * SYMBOL] != b[d * SYMBOL:(d + 1) * SYMBOL]:
            return d
    return n


def splitters(cut: DataFrame) -> tuple[list[int], list[int], list[int]]:
    """Shards that hold rows, symbols shared within each, and symbols shared over each cut between two."""
    ends = stage(cut.groupBy(RANGE).agg(F.min("path").alias("first"), F.max("path").alias("last")), "trie-splitters")
    shards = sorted(r[0] for r in ends.select(RANGE).collect())
    if not shards:
        return [], [], []
    spark = cut.sparkSession
    after = spark.createDataFrame(list(zip(shards, [*shards[1:], None])), f"{RANGE} int, _next int")
    right = ends.select(F.col(RANGE).alias("_next"), F.col("first").alias("then"))

    def count(batches):
        for b in batches:
            a = [b.column(c).to_pylist() for c in (RANGE, "first", "last", "then")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[0], pa.int32()), pa.array([_shared(x, y) for x, y in zip(a[1], a[2])], pa.int64()),
                 pa.array([None if z is None else _shared(y, z) for y, z in zip(a[2], a[3])], pa.int64())],
                [RANGE, "inside", "across"])

    got = ends.join(after, RANGE).join(right, "_next", "left").mapInArrow(count, f"{RANGE} int, inside long, across long")
    by = {r[0]: r for r in got.collect()}
    return shards, [by[s][1] for s in shards], [by[s][2] for s in shards[:-1]]


class Skeleton:
    """The trie of splitter paths as numbers of shared symbols.

    Cut ``b`` lies between shards ``b`` and ``b + 1``.  A skeleton node is
    (owner, depth): its first cut and its depth.  ``floor[b]`` is the depth
    down to which nodes at cut ``b`` have begun before it.
    """

    def __init__(self, inside: list[int], across: list[int]):
        self.inside, self.across, self.floor, self.parent = inside, across, [], []
        for b, owners in enumerate(self.walk()):
            self.floor.append(owners[0])
            self.parent.append(owners[1])

    def walk(self) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """For each cut: its floor, the owner of the node on the floor, and (depth reached, owner) steps down."""
        steps: list[tuple[int, int]] = []
        for b, d in enumerate(self.across):
            floor = min(self.inside[b], self.across[b - 1]) if b else -1
            while steps and (steps[-2][0] if len(steps) > 1 else -1) >= floor:
                steps.pop()
            if steps:
                steps[-1] = (min(steps[-1][0], floor), steps[-1][1])
            on_floor = steps[-1][1] if steps else -1
            if d > floor:
                steps.append((d, b))
            else:
                while (steps[-2][0] if len(steps) > 1 else -1) >= d:
                    steps.pop()
                steps[-1] = (d, steps[-1][1])
            yield floor, on_floor, list(steps)

    def owners(self, shards: set[int]) -> dict[int, tuple[list[int], list[int]]]:
        """For each of these shards the owner by depth on its left and on its right side."""
        flat, out, last = (lambda steps: [o for k, (d, o) in enumerate(steps) for _ in range((steps[k - 1][0] if k else -1), d)]), {}, []
        for b, (_, _, steps) in enumerate(self.walk()):
            if b in shards:
                out[b] = (last, flat(steps))
            last = flat(steps) if b + 1 in shards else []
        if len(self.across) in shards:
            out[len(self.across)] = (last, [])
        return out


class _Node:
    __slots__ = ("conv", "n", "children", "leaves", "saved", "chars", "ends", "ids", "pending", "owner", "begins")

    def __init__(self, chars: int, owner: int | None, begins: bool):
        self.conv, self.n, self.children, self.leaves, self.saved, self.chars = None, 0, 0, 0, 0, chars
        self.ends, self.ids, self.pending, self.owner, self.begins = None, array("q"), [], owner, begins


def _walk_shard(shard: int, rows: list[tuple], left: list[int], right: list[int]) -> Iterator[tuple]:
    """All rows of a shard; ``left`` and ``right``: owners by depth of the nodes it shares with its neighbours."""
    stack: list[_Node] = []
    last, blank, part = rows[-1][1], hashlib.sha256().hexdigest(), 0

    def ids_row(x: _Node, depth: int) -> tuple:
        nonlocal part
        part += 1
        ids, x.ids = x.ids, array("q")
        return ("ends", shard, x.owner, depth, *[None] * 9, part, ids.tobytes())

    def finished(depth: int, own: tuple, parent_owner: int | None, parent: int | None) -> tuple:
        conv, n, children, leaves, saved, ends = own
        return ("node", shard, None, depth, conv, parent_owner, parent, n, children, leaves, saved, None, ends, None, None)

    def close() -> Iterator[tuple]:
        depth, x = len(stack) - 1, stack.pop()
        up = stack[-1] if stack else None
        if up is not None:
            up.n += x.n
            up.conv = x.conv if up.conv is None else min(up.conv, x.conv)
            up.children += x.begins
        if x.owner is not None:
            if x.ids:
                yield ids_row(x, depth)
            yield ("part", shard, x.owner, depth, x.conv, up.owner if up else None, None, x.n, x.children, x.leaves, x.saved, x.chars,
                   None, None, None)
            return
        x.leaves += not x.children
        x.saved += (x.n - 1) * x.chars
        for child in x.pending:
            yield finished(depth + 1, child, None, x.conv)
        own = (x.conv, x.n, x.children, x.leaves, x.saved, x.ends.hexdigest() if x.ends else blank)
        if up is None:
            yield finished(0, own, None, None)
            return
        up.leaves += x.leaves
        up.saved += x.saved
        if up.owner is None:
            up.pending.append(own)
        else:
            yield finished(depth, own, up.owner, None)

    before = None
    for conv, path, chars in rows:
        keep = 0 if before is None else _shared(before, path) + 1
        while len(stack) > keep:
            yield from close()
        for d in range(len(stack), len(chars) + 1):
            if before is None and d < len(left):
                node = _Node(chars[d - 1] if d else 0, left[d], False)
            else:
                on_right = d < len(right) and last.startswith(path[:d * SYMBOL])
                node = _Node(chars[d - 1] if d else 0, right[d] if on_right else None, True)
            stack.append(node)
        x = stack[-1]
        x.n += 1
        x.conv = conv if x.conv is None else min(x.conv, conv)
        if x.owner is not None:
            x.ids.append(conv)
            if len(x.ids) >= IDS_A_ROW:
                yield ids_row(x, len(stack) - 1)
        elif x.ends is None:
            x.ends = hashlib.sha256(b"%d" % conv)
        else:
            x.ends.update(b",%d" % conv)
        before = path
    while stack:
        yield from close()


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    out = []
    for r in rows:
        out.append(r)
        if len(out) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _rows(batches, names: list[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in names))


def walk_shards(cut: DataFrame, shards: list[int], skeleton: Skeleton) -> DataFrame:
    """Finished nodes ('node'), partial skeleton nodes ('part') and lists of members that end in them ('ends')."""
    spark = cut.sparkSession
    told = spark.sparkContext.broadcast((shards, skeleton.inside, skeleton.across))

    def run(batches):
        numbers, inside, across = told.value
        at, sk = {s: i for i, s in enumerate(numbers)}, Skeleton(inside, across)
        rows = _rows(batches, [RANGE, "conv_id", "path", "chars"])

        def all_rows():
            for number, own in groupby(rows, key=itemgetter(0)):
                left, right = sk.owners({at[number]})[at[number]]
                yield from _walk_shard(at[number], [r[1:] for r in own], left, right)

        yield from _batches(all_rows(), _ROW)

    dealt = cut.repartition(RANGE).sortWithinPartitions(RANGE, "path", "conv_id")
    return stage(dealt.select(RANGE, "conv_id", "path", "chars").mapInArrow(run, _DDL), "trie-nodes", partition_by="kind")


def _digests(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256 from packed id lists in order."""
    schema = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches):
        def digests():
            for (owner, depth), parts in groupby(_rows(batches, ["owner", "depth", "ids"]), key=itemgetter(0, 1)):
                sha, comma = hashlib.sha256(), b""
                for *_, ids in parts:
                    sha.update(comma + b",".join(b"%d" % i for i in array("q", ids)))
                    comma = b","
                yield owner, depth, sha.hexdigest()

        yield from _batches(digests(), schema)

    dealt = ends.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "shard", "part")
    return dealt.select("owner", "depth", "ids").mapInArrow(run, "owner long, depth long, ends_sha256 string")


def _finish_skeleton(parts: DataFrame, ends: DataFrame, skeleton: Skeleton) -> DataFrame:
    """One row a skeleton node, from the partial rows of all shards."""
    spark = parts.sparkSession
    one = parts.groupBy("owner", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.max("parent_owner").alias("parent_owner"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.max("last_chars").alias("last_chars"))
    one = stage(one.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long"))
                .withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("last_chars")), "trie-skeleton")
    sums = {r[0]: [r[1], r[2]] for r in one.groupBy("owner").agg(F.sum("n_leaves"), F.sum("saved_tokens")).collect()}
    hung: dict[tuple[int, int], list[int]] = {}
    for b in sorted(sums, reverse=True):
        if b:
            at = hung.setdefault((skeleton.parent[b], skeleton.floor[b]), [0, 0])
            for k in (0, 1):
                at[k] += sums[b][k]
                sums[skeleton.parent[b]][k] += sums[b][k]
    more = spark.createDataFrame([(*k, *v) for k, v in hung.items()], "owner long, depth long, more_leaves long, more_saved long")
    below = Window.partitionBy("owner").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    one = (one.join(more, ["owner", "depth"], "left")
           .withColumn("n_leaves", F.sum(F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).over(below))
           .withColumn("saved_tokens", F.sum(F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).over(below)))
    up = one.select(F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    one = (one.join(up, ["parent_owner", "depth"], "left").join(_digests(ends), ["owner", "depth"], "left")
           .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))))
    return stage(one.select("owner", *RESULT), "trie-skeleton")


def trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """(conv_id, path, chars) -> one row a node, as the query returns them.

    ``path`` holds ``SYMBOL`` characters a turn and ``chars`` the code points
    of each turn's text; ``conv_id`` is unique.
    """
    cut = cut_ranges(paths.select("conv_id", "path", "chars"), ["path", "conv_id"], shards)
    numbers, inside, across = splitters(cut)
    sk = Skeleton(inside, across)
    if not numbers:
        return paths.sparkSession.createDataFrame([], _DDL).select(*RESULT)
    rows = walk_shards(cut, numbers, sk)
    local = rows.where("kind = 'node'")
    whole = local.where(F.col("parent_owner").isNull()).select(*RESULT)
    if not across:
        return whole
    bones = _finish_skeleton(rows.where("kind = 'part'"), rows.where("kind = 'ends'"), sk)
    spine = rows.where("kind = 'part'").select("shard", "owner", "depth").join(
        bones.select("owner", "depth", F.col("conv_id").alias("up")), ["owner", "depth"])
    spine = spine.select("shard", F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"), "up")
    top = (local.where(F.col("parent_owner").isNotNull()).drop("parent_conv_id")
           .join(spine, ["shard", "parent_owner", "depth"]).withColumnRenamed("up", "parent_conv_id").select(*RESULT))
    return whole.unionByName(top).unionByName(bones.select(*RESULT))


def query(rows: DataFrame) -> DataFrame:
    return trie(rebuilt(rows))


#: The same nodes in DuckDB SQL; crc32 is spelled out, a node is the list of its turns.
SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
        lambda x, y: list_reduce(list_prepend(xor(x, y), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
          lambda a, z: xor(a >> 1, 3988292384::BIGINT * (a & 1)))), 4294967295::BIGINT) % 6 AS h FROM o),
r AS (SELECT h.conv_id, list_concat(CASE WHEN b.conv_id IS NULL THEN [] ELSE b.turns[1:h.h] END, h.turns[h.h + 1:]) AS turns
      FROM h LEFT JOIN o AS b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, len(turns)::BIGINT AS size, unnest(range(0, len(turns) + 1))::BIGINT AS depth, turns FROM r),
q AS (SELECT conv_id, size, depth, turns[1:depth] AS node,
        CASE WHEN depth > 0 THEN length(turns[depth].text) ELSE 0 END AS chars FROM p),
n AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
      FROM q GROUP BY depth, node),
k AS (SELECT depth - 1 AS depth, node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.depth = n.depth AND k.node = n.node),
a AS (SELECT q.depth, q.node, count(*) FILTER (WHERE m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.chars) AS saved_tokens
      FROM m JOIN q ON q.conv_id = m.conv_id AND q.depth <= m.depth GROUP BY q.depth, q.node)
SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
       a.n_leaves::BIGINT AS n_leaves, a.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN a ON a.depth = m.depth AND a.node = m.node
LEFT JOIN m AS up ON up.depth = m.depth - 1 AND up.node = m.node[1:m.depth - 1] AND m.depth > 0
"""
