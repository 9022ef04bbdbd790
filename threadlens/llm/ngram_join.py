"""Documents whose five-word shingle sets are alike, by a grouped prefix join.

The shingles of a set are put in a common order, rare ones first. Two sets with a
Jaccard similarity of 0.8 or more share a shingle within their prefixes (the first
n - ceil(0.8 n) + 1). Sets of one size whose prefixes are identical form one group
and are joined as one; group pairs that share no prefix shingle or differ too much
in size are filtered; the members of the others are expanded and verified by exact
intersections.

1. ``_shingled`` reduces each text to its distinct shingles (48 bits of hash).
   Equal sets of one slice are sent once. A shingle that many sets of a slice
   hold is sent once for the slice, so a passage that a third of all texts share
   stays small.
2. ``_counted`` counts, by range of shingle hashes, the sets that hold each
   shingle; the count ends at ``FREQUENT``, from where the order is by hash alone
   (any common order is right). Shingles of one set only are dropped here: they
   cannot be shared, and only their number matters.
3. ``_ordered`` gathers what is left of each set. A set whose prefix holds only
   shingles of its own can have no partner and is done. That ends most texts.
4. Groups that share prefix shingles are clustered. A small cluster is joined
   within one task; a large one is dealt into blocks, and pairs of blocks that
   share a prefix shingle become tasks of bounded size. A large group is dealt
   out by set, so it lies in many blocks.
5. Links are counted in place (matrix products of the members' shingles) and only
   spanning edges leave a task, so near copies by the thousand cost no rows. The
   links' connected components are the result.

Defined results: null, empty and wordless texts have no shingles and no links;
with fewer than five words the whole sequence is the one shingle; repeated rows
are linked like other copies; ``component_id`` is null only if all ids of a
component are; an empty table gives no rows. Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, partitions, slices, stored, table
from .components import components
from .words import shingles, split

#: Counts of sets by shingle end here.
FREQUENT = 64
#: Sets of one block of a large cluster.
BLOCK = 512
#: A group of more than one of so many parts of a block is dealt out by set.
PIECES = 8
#: Columns of one matrix product.
COLUMNS = 4096
_KEPT_BITS = 48


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], "<u4").tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    lengths, at, out = np.frombuffer(blob, "<u4", len(kinds)), 4 * len(kinds), []
    for n, kind in zip(lengths, kinds, strict=True):
        out.append(np.frombuffer(blob, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _halves(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48-bit values as 32 and 16 bits."""
    return h.astype("<u4"), (h >> np.uint64(32)).astype("<u2")


def _whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))


def _by_set(sid: np.ndarray, n: np.ndarray, h: np.ndarray, count: np.ndarray) -> bytes:
    """Entries sorted by set, each set's id and size once."""
    order = np.argsort(sid, kind="stable")
    sid, n, h, count = sid[order], n[order], h[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], sid[1:] != sid[:-1]]))
    return _pack(sid[first], n[first].astype("<u4"), np.diff(np.append(first, len(sid))).astype("<u4"), *_halves(h), count.astype("u1"))


def _sets_of(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    parts = [_unpack(b, "<u8", "<u4", "<u4", "<u4", "<u2", "u1") for b in blobs]
    return (np.concatenate([np.repeat(p[0], p[2]) for p in parts]), np.concatenate([np.repeat(p[1], p[2]) for p in parts]),
            np.concatenate([_whole(p[3], p[4]) for p in parts]), np.concatenate([p[5] for p in parts]))


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


# Rows on the way are either documents (``sid`` set) or packed entries for a bucket.
_WAY = "bucket int, target int, doc_id long, n long, sid long, blob binary"
_WAY_ARROW = pa.schema([("bucket", pa.int32()), ("target", pa.int32()), ("doc_id", pa.int64()),
                        ("n", pa.int64()), ("sid", pa.int64()), ("blob", pa.binary())])
_SETS = "doc_id long, n long, sid long, gid long, prefix array<long>, tokens binary"
_SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("gid", pa.int64()),
                         ("prefix", pa.list_(pa.int64())), ("tokens", pa.binary())])


def _shingled(n_buckets: int, n_targets: int):
    """Texts to document rows and packed (shingle, set) entries by bucket of shingles."""
    bounds = np.array([(b << _KEPT_BITS) // n_buckets for b in range(n_buckets + 1)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            known: dict[int, int] = {}
            sets, sids, sizes, ns = [], [], [], []
            for text in batch.column("text").to_pylist():
                a = shingles(split(text or ""))
                sid = xxhash.xxh3_64_intdigest(a.tobytes(), seed=len(a)) if len(a) else 0
                if len(a) and sid not in known:
                    known[sid] = len(sets)
                    sets.append(a)
                    sizes.append(len(a))
                ns.append(len(a))
                sids.append(sid)
            own = np.array(sids, np.uint64)
            at = ((own + np.arange(len(own), dtype=np.uint64)) % np.uint64(n_buckets)).astype(np.int32)
            yield _rows(_WAY_ARROW, bucket=at, target=at % n_targets, doc_id=batch.column("doc_id"), n=ns, sid=own.view(np.int64))
            if sets:
                yield _entries(sets, np.array(list(known), "<u8"), np.array(sizes, "<u4"), bounds, n_targets)

    return run


def _entries(sets, sids, sizes, bounds, n_targets: int) -> pa.RecordBatch:
    h = np.concatenate(sets) >> np.uint64(64 - _KEPT_BITS)
    owner = np.repeat(np.arange(len(sets), dtype="<u2"), sizes)
    order = np.argsort(h)
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    run = np.diff(np.append(first, len(h)))
    hot = np.repeat(run >= FREQUENT, run)
    hot_h = h[first[run >= FREQUENT]]
    buckets, targets, blobs = [], [], []
    for s in (hot,) if hot.any() else ():
        # What is frequent here is frequent anywhere: its sets learn so at once.
        where = sids[owner[s]] % np.uint64(n_targets)
        for t in np.unique(where):
            m = where == t
            o = owner[s][m]
            buckets.append(int(t) % (len(bounds) - 1))
            targets.append(int(t))
            blobs.append(_by_set(sids[o], sizes[o], h[s][m], np.full(m.sum(), FREQUENT)))
        h, owner = h[~s], owner[~s]
    cut, hot_cut = np.searchsorted(h, bounds), np.searchsorted(hot_h, bounds)
    for b in range(len(bounds) - 1):
        lo, hi, some = cut[b], cut[b + 1], hot_h[hot_cut[b]:hot_cut[b + 1]]
        if hi > lo or len(some):
            used, local = np.unique(owner[lo:hi], return_inverse=True)
            buckets.append(b)
            targets.append(None)
            blobs.append(_pack(sids[used], sizes[used], *_halves(h[lo:hi]), local.astype("<u2"), *_halves(some)))
    return _rows(_WAY_ARROW, bucket=buckets, target=targets, blob=blobs)


def _counted(n_targets: int):
    """One bucket of shingles: what two or more sets share, by bucket of sets; all else passes."""
    def run(rows: pa.Table) -> pa.Table:
        passing = rows.filter(rows["target"].is_valid())
        blobs = rows["blob"].filter(rows["target"].is_null()).to_pylist()
        if not blobs:
            return passing
        parts = [_unpack(b, "<u8", "<u4", "<u4", "<u2", "<u2", "<u4", "<u2") for b in blobs]
        h = np.concatenate([_whole(p[2], p[3]) for p in parts])
        sid = np.concatenate([p[0][p[4]] for p in parts])
        n = np.concatenate([p[1][p[4]] for p in parts])
        hot = np.unique(np.concatenate([_whole(p[5], p[6]) for p in parts]))
        order = np.argsort(h, kind="stable")
        h = h[order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        run_length = np.diff(np.append(first, len(h)))
        frequent = np.zeros(len(first), bool)
        if len(hot) and len(first):
            place = np.minimum(np.searchsorted(hot, h[first]), len(hot) - 1)
            frequent = hot[place] == h[first]
        some = np.repeat((run_length > 1) | frequent, run_length)
        h, sid, n = h[some], sid[order][some], n[order][some]
        order = np.lexsort((sid, h))  # equal sets of several slices count once
        h, sid, n = h[order], sid[order], n[order]
        if not len(h):
            return passing
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])])
        h, sid, n = h[keep], sid[keep], n[keep]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        length = np.diff(np.append(first, len(h)))
        count = np.minimum(length, FREQUENT)
        if len(hot):
            place = np.minimum(np.searchsorted(hot, h[first]), len(hot) - 1)
            count[hot[place] == h[first]] = FREQUENT
        count = np.repeat(count, length)
        some = count > 1
        h, sid, n, count = h[some], sid[some], n[some], count[some]
        where = (sid % np.uint64(n_targets)).astype(np.int32)
        order = np.argsort(where, kind="stable")
        ends = np.searchsorted(where[order], np.arange(n_targets + 1))
        targets, packed = [], []
        for t in np.flatnonzero(np.diff(ends)):
            o = order[ends[t]:ends[t + 1]]
            targets.append(int(t))
            packed.append(_by_set(sid[o], n[o], h[o], count[o]))
        got = _rows(_WAY_ARROW, bucket=[0] * len(targets), target=targets, blob=packed)
        return pa.concat_tables([passing.cast(_WAY_ARROW), pa.Table.from_batches([got])])

    return run


def least_common(n):
    """ceil(0.8 n)."""
    return (4 * n + 4) // 5


def _ordered(rows: pa.Table) -> pa.Table:
    """One bucket of sets: documents pass; sets that may have partners, with their group and prefix."""
    docs = rows.filter(rows["sid"].is_valid())
    out = [_rows(_SETS_ARROW, doc_id=docs["doc_id"].combine_chunks(), n=docs["n"].combine_chunks(), sid=docs["sid"].combine_chunks())]
    blobs = rows["blob"].filter(rows["sid"].is_null()).to_pylist()
    if blobs:
        sid, n, h, count = _sets_of(blobs)
        order = np.lexsort((h, count, sid))
        sid, n, h, count = sid[order], n[order], h[order], count[order]
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])])
        sid, n, h = sid[keep], n[keep], h[keep]
        first = np.flatnonzero(np.concatenate([[True], sid[1:] != sid[:-1]]))
        length = np.diff(np.append(first, len(sid)))
        size = n[first].astype(np.int64)
        # Shingles of no other set come first in the order; a prefix of them alone has no partner.
        in_prefix = size - least_common(size) + 1 - (size - length)
        live = np.flatnonzero(in_prefix > 0)
        tokens = [h[first[k]:first[k] + length[k]] for k in live]
        prefix = [t[:in_prefix[k]] for t, k in zip(tokens, live, strict=True)]
        gids = [xxhash.xxh3_64_intdigest(p.tobytes(), seed=int(size[k])) for p, k in zip(prefix, live, strict=True)]
        out.append(_rows(
            _SETS_ARROW, n=size[live], sid=sid[first[live]].view(np.int64), gid=np.array(gids, np.uint64).view(np.int64),
            prefix=[p.astype(np.int64) for p in prefix], tokens=[t.tobytes() for t in tokens]))
    return pa.Table.from_batches(out)


def joined_pairs(size: np.ndarray, gid: np.ndarray, prefix: list[np.ndarray], tokens: list[np.ndarray],
                 left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all linked sets with ``left[i]`` and ``right[j]``; i < j where both could be either.

    First groups are compared (sizes, a shared prefix shingle), then the members of
    the group pairs that stay.
    """
    _, rep, group = np.unique(gid, return_index=True, return_inverse=True)
    shared = _products([prefix[r] for r in rep]) > 0
    s = size[rep]
    fits = shared & (5 * np.minimum.outer(s, s) >= 4 * np.maximum.outer(s, s))
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    pairs = fits[np.ix_(group[a], group[b])]
    either = left[a][:, None] & right[a][:, None] if len(a) == len(b) and (a == b).all() else None
    i, j = np.nonzero(pairs if either is None else np.triu(pairs, 1))
    i, j = a[i], b[j]
    if len(i) == 0:
        return i, j
    if len(i) > 4 * (len(a) + len(b)):
        common = _products(tokens)[i, j]
    else:
        ordered = {k: np.sort(tokens[k]) for k in {*i.tolist(), *j.tolist()}}
        common = np.array([len(np.intersect1d(ordered[x], ordered[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)])
    ok = 9 * common >= 4 * (size[i] + size[j])
    return i[ok], j[ok]


def _products(lists: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections, column block by column block."""
    flat = np.concatenate(lists)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    many = n[column] > 1
    dense = np.cumsum(n > 1) - 1
    owner, column = owner[many], dense[column[many]]
    out = np.diag([len(x) for x in lists]).astype(np.int64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros(out.shape, np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        x = np.zeros((len(lists), min(COLUMNS, int(column[-1]) + 1 - lo)), np.float32)
        x[owner[a:b], column[a:b] - lo] = 1
        total += x @ x.T
    np.fill_diagonal(total, 0)
    return out + np.rint(total).astype(np.int64)


_LINKS = "sid long, root long, n_links long"


def _verified(rows: pa.Table) -> pa.Table:
    """Links within each cluster, or between two blocks of one, of a task's rows."""
    item, side = rows["item"].to_numpy(), rows["side"].to_numpy()
    size, gid, sid, mult = (rows[c].to_numpy() for c in ("n", "gid", "sid", "copies"))
    blobs, lengths = rows["tokens"].to_pylist(), rows["k"].to_numpy()
    out_sid, out_root, out_n = [], [], []
    order = np.argsort(item, kind="stable")
    ends = np.flatnonzero(np.concatenate([[True], item[order][1:] != item[order][:-1], [True]]))
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        o = order[lo:hi]
        tokens = [np.frombuffer(blobs[k], "<u8") for k in o]
        prefix = [t[:lengths[k]] for t, k in zip(tokens, o, strict=True)]
        left, right = side[o] != 2, side[o] != 1
        i, j = joined_pairs(size[o], gid[o], prefix, tokens, left, right)
        if not len(i):
            continue
        links = np.zeros(len(o), np.int64)
        np.add.at(links, i, mult[o][j])
        np.add.at(links, j, mult[o][i])
        root = np.arange(len(o))
        while True:  # the smallest index spreads along links, then along roots
            m = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, m)
            np.minimum.at(new, j, m)
            new = new[new]
            if (new == root).all():
                break
            root = new
        linked = np.flatnonzero(links)
        out_sid.append(sid[o][linked])
        out_root.append(sid[o][root[linked]])
        out_n.append(links[linked])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.table({"sid": cat(out_sid), "root": cat(out_root), "n_links": cat(out_n)})


def _tasks(groups: DataFrame, sets: DataFrame, n_packs: int) -> DataFrame:
    """The sets of every task: small clusters packed together, pairs of blocks of large ones.

    Clusters and blocks are found on one row a group (``gid``, ``prefix`` and the
    number of its sets, ``held``); the sets join the result once.
    """
    tokens = groups.select("gid", F.explode("prefix").alias("token"))
    hubs = tokens.groupBy("token").agg(F.min("gid").alias("hub"), F.count("*").alias("c"))
    shared = stored(tokens.join(hubs.where("c > 1"), "token").select("gid", "hub", "token"), "prefixes")
    # A group of several sets is a cluster even if no other group shares its prefix.
    cluster = components(shared.select(F.col("gid").alias("a"), F.col("hub").alias("b")).distinct())
    whole = stored(groups.select("gid", "held").join(cluster.withColumnRenamed("node", "gid"), "gid", "left").select(
        "gid", "held", F.coalesce("label", "gid").alias("cluster")), "groups")
    counts = stored(whole.groupBy("cluster").agg(F.sum("held").alias("members")).where("members > 1"), "clusters")
    # A group above the size of a piece is dealt out by set, so that no block holds it whole.
    whole = stored(whole.join(counts, "cluster").select(
        "gid", "cluster", F.ceil(F.col("members") / BLOCK).cast("long").alias("blocks"),
        F.ceil(F.col("held") / max(1, BLOCK // PIECES)).cast("long").alias("pieces")), "blocks")
    block = F.pmod(F.xxhash64("gid", "piece"), "blocks").alias("block")
    placed = sets.join(whole, "gid").withColumn("piece", F.pmod(F.xxhash64("sid"), "pieces"))
    columns = ["item", "side", "n", "gid", "sid", "k", "copies", "tokens"]
    small = placed.where("blocks = 1").withColumn("pack", F.pmod(F.xxhash64("cluster"), F.lit(n_packs))).withColumns(
        {"item": F.col("cluster"), "side": F.lit(0)}).select("pack", *columns)
    large = placed.where("blocks > 1").withColumn("block", block)
    dealt = whole.where("blocks > 1").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).select(
        "gid", "cluster", block).distinct()
    # Every block with itself, and pairs that share a group or a prefix shingle.
    held = dealt.join(shared.select("gid", "token"), "gid").select("cluster", "token", "block").union(
        dealt.select("cluster", "gid", "block")).distinct()
    other = held.withColumnRenamed("block", "other")
    pairs = held.join(other, ["cluster", "token"]).where("block < other").select("cluster", "block", "other").union(
        dealt.select("cluster", "block", F.col("block").alias("other"))).distinct()
    pairs = pairs.withColumn("item", F.xxhash64("cluster", "block", "other"))
    ends = pairs.select("cluster", "block", "item", F.when(F.col("block") == F.col("other"), 0).otherwise(1).alias("side")).union(
        pairs.where("block <> other").select("cluster", F.col("other").alias("block"), "item", F.lit(2)))
    apart = large.join(ends, ["cluster", "block"]).withColumn("pack", F.col("item")).select("pack", *columns)
    return small.union(apart)


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row.

    ``n_links`` counts the other documents that are linked directly, copies included.
    """
    spark = docs.sparkSession
    n_targets = partitions(spark)
    n_buckets = 3 * n_targets
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    way = source.mapInArrow(_shingled(n_buckets, n_targets), _WAY)
    way = way.groupBy("bucket").applyInArrow(_counted(n_targets), _WAY)
    rows = stored(way.groupBy("target").applyInArrow(_ordered, _SETS), "sets")

    ids = rows.where("tokens IS NULL").select("doc_id", "n", "sid")
    per_set = stored(ids.where("n > 0").groupBy("sid").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "copies")
    sets = rows.where("tokens IS NOT NULL").select("n", "sid", "gid", F.size("prefix").alias("k"), "tokens").join(
        per_set.select("sid", "copies"), "sid")
    groups = rows.where("tokens IS NOT NULL").groupBy("gid").agg(F.first("prefix").alias("prefix"), F.count("*").alias("held"))
    tasks = _tasks(groups, sets, 8 * n_targets)
    links = stored(tasks.groupBy("pack").applyInArrow(_verified, _LINKS), "links")

    label = components(links.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    direct = links.groupBy("sid").agg(F.sum("n_links").alias("n_links"))
    of_set = per_set.join(label.withColumnRenamed("node", "sid"), "sid", "left").join(direct, "sid", "left")
    of_set = of_set.withColumn("label", F.coalesce("label", "sid"))
    least = of_set.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_set = stored(of_set.join(least, "label").select(
        "sid", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    some, none = ids.where("n > 0"), ids.where("n = 0")
    return some.join(of_set, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links").union(
        none.select("doc_id", "n", F.col("doc_id"), F.lit(0).cast("long")))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of linked documents and the number of its links."""
    return linked(only(table(spark, sf_dir, "documents"), "doc_id", "text"))


QUERIES = {"op1_ngram_jaccard_join": op1_ngram_jaccard_join}
SQL: dict[str, str] = {}
