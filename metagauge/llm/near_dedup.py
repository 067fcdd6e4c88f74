"""MinHash near-dedup with sequential Bayesian verification of banded candidates.

Texts with equal shingle sets are one node. Nodes that share a band of their signatures are candidates. Every node of a band
is compared with the band's hub, the node that shares bands with the most others, which among copies of one text tends to be
that text; so a group of near copies costs about as many comparisons as it has members. Only nodes of one band that are still
in different components then are compared with each other, in blocks of bounded size, each pair in the first band that it
shares; a block gives no more links than join its components. A comparison looks at the signatures batch by batch and gives up
as soon as the posterior says that the similarity is below the limit, but for a chosen chance of error; what is left is decided
on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metagauge.llm.components import components
from metagauge.llm.tables import FIRST_KEY, order_key, partitions, stored, text_digest, whole_row
from metagauge.llm.words import FOLD, NOT_SPACE, hashes, mix, shingles, spans, steps, text_bytes

#: Rows of a band and bands. A link at similarity 0.8 shares no band with chance (1 - 0.8**5)**32, three in a million.
ROWS, BANDS = 5, 32
#: Signature values of one step of the sequential comparison.
BATCH = 32
#: Shingles of the members of a band that one task compares with as many others; a member counts for LEAST at least.
BLOCK, LEAST = 2_048_000, 2_000
#: Shingles whose occurrences in a block are counted at once.
_COLUMNS = 8192
_N = ROWS * BANDS
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, _N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, _N, dtype=np.uint64)


def sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in ascending order, end to end, and where each text's begin."""
    data, borders = text_bytes(column)
    starts, ends, first = spans(data, borders, NOT_SPACE)
    found, first = shingles(hashes(FOLD[data], starts, ends), first, n)
    new = np.ones(len(found), bool)
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a > 1:
            own = found[a:b]
            own.sort()
            np.not_equal(own[1:], own[:-1], out=new[a + 1 : b])
    kept = np.concatenate([[0], np.cumsum(new)])
    return found[new], kept[first]


def _per_text(values: np.ndarray, first: np.ndarray, how) -> np.ndarray:
    """``how`` over the values of each text that has any."""
    return how.reduceat(values, first[:-1][np.diff(first) > 0])


def digests(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number for each set, whatever the order of its members; texts without any are left out."""
    return mix(_per_text(mix(found ^ np.uint64(0x5851F42D4C957F2D)), first, np.add)).view(np.int64)


def signatures(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    begin = first[:-1][np.diff(first) > 0]
    out = np.empty((len(begin), _N), np.uint32)
    work = np.empty_like(found)
    for k in range(_N):
        np.multiply(found, _A[k], out=work)
        work += _B[k]
        out[:, k] = np.minimum.reduceat(work, begin) >> np.uint64(32)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.empty((len(signature), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(signature), b + 1, np.uint64)
        for row in signature[:, b * ROWS : (b + 1) * ROWS].T:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
        keys[:, b] = key
    return keys.view(np.int64)


def _signed(docs: DataFrame, n: int, *carried: str) -> DataFrame:
    """``key, digest, n_shingles, node, signature, bands`` of every row and the numbers that it carries; no node without
    shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", 400_000):
                found, first = sets(part.column("text"), n)
                count = np.diff(first)
                none = count == 0
                node = np.zeros(len(count), np.int64)
                signature = np.zeros((len(count), _N), np.uint32)
                bands = np.zeros((len(count), BANDS), np.int64)
                if len(found):
                    node[~none], signature[~none] = digests(found, first), signatures(found, first)
                    bands[~none] = band_keys(signature[~none])
                raw = pa.py_buffer(signature.tobytes())
                at = pa.array(np.arange(len(count) + 1, dtype=np.int32) * (4 * _N)).buffers()[1]
                offsets = pa.array(np.arange(len(count) + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        part.column("digest"),
                        pa.array(count),
                        pa.array(node, mask=none),
                        pa.BinaryArray.from_buffers(pa.binary(), len(count), [None, at, raw]),
                        pa.ListArray.from_arrays(offsets, pa.array(bands.reshape(-1))),
                        *[part.column(c) for c in carried],
                    ],
                    names=["key", "digest", "n_shingles", "node", "signature", "bands", *carried],
                )

    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(order_key().alias("key"), text_digest().alias("digest"), text, *carried)
    schema = "key long, digest long, n_shingles long, node long, signature binary, bands array<long>"
    return rows.mapInArrow(sign, ", ".join([schema, *[f"{c} long" for c in carried]]))


def least_matches(similarity: float, miss: float) -> list[int]:
    """How many of the first 32, 64, ... values must agree for a pair to stay.

    With all similarities alike beforehand, m matches of n leave a Beta posterior, whose share at or above the limit is the
    chance that a binomial of n + 1 draws is m or less.
    """
    out = []
    for n in range(BATCH, _N + 1, BATCH):
        chance, m = 0.0, -1
        while m < n:
            chance += comb(n + 1, m + 1) * similarity ** (m + 1) * (1 - similarity) ** (n - m)
            m += 1
            if chance >= miss:
                break
        out.append(m)
    return out


def _as_matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, _N), np.uint32)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.uint32).reshape(-1, _N)


def _may_be_alike(a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of rows that no batch rules out, and how many values they share."""
    left, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, need in enumerate(least):
        at = slice(i * BATCH, (i + 1) * BATCH)
        matches = matches + (a[left, at] == b[left, at]).sum(1)
        stays = matches >= need
        left, matches = left[stays], matches[stays]
    return left, matches


def _size_allows(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _compared(pairs: DataFrame, signed: DataFrame, percent: int, least: list[int]) -> DataFrame:
    """The pairs ``a, b`` that their signatures don't rule out."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays, _ = _may_be_alike(_as_matrix(batch.column("sa")), _as_matrix(batch.column("sb")), least)
            yield batch.select(["a", "b"]).take(pa.array(stays))

    left = signed.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
    right = signed.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").filter(_size_allows("na", "nb", percent))
    return both.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column("xa"), batch.column("xb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    left = full.select(F.col("node").alias("a"), F.col("members").alias("xa"))
    right = full.select(F.col("node").alias("b"), F.col("members").alias("xb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "xa", "xb").mapInArrow(verify, "a long, b long")


def _full_sets(docs: DataFrame, signed: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """``node, members``: the shingles of the nodes, from the text of the first row of each.

    A row is found again by its id and the digest of its text, so it meets its own node only, however many share the id. Of
    rows equal in both, those that do not come one after the other are told apart at the end.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for part in steps(batch, "text", 400_000):
                found, at = sets(part.column("text"), n)
                if not len(found):
                    continue
                own = np.flatnonzero(np.diff(at))
                node = part.column("node").to_numpy()
                same = own[digests(found, at) == node[own]]
                repeated = node[same][1:] == node[same][:-1]  # a row that is repeated comes again at once
                same = same[np.concatenate([node[same][:1] != last, ~repeated])]
                if not len(same):
                    continue
                last = node[same[-1]]
                members = pa.array([found[at[i] : at[i + 1]].tobytes() for i in same.tolist()], pa.binary())
                node, several = (part.column(c).take(pa.array(same)) for c in ("node", "several"))
                yield pa.RecordBatch.from_arrays([node, several, members], names=["node", "several", "members"])

    texts = signed.filter("node is not null").groupBy("node", "key", "digest").agg((F.count(F.lit(1)) > 1).alias("several"))
    first = texts.groupBy("node").agg(F.min(F.struct("key", "digest", "several")).alias("first"))
    wanted = first.join(nodes, "node").select("node", "first.*")
    rows = docs.select(order_key().alias("key"), text_digest().alias("digest"), "text").join(wanted, ["key", "digest"])
    found = stored(rows.select("node", "several", "text").mapInArrow(build, "node long, several boolean, members binary"))
    again = stored(found.filter("several").dropDuplicates(["node"]))
    return found.filter("not several").unionByName(again).select("node", "members")


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band in which each pair of signatures agrees."""
    return (a == b).reshape(len(a), BANDS, ROWS).all(2).argmax(1)


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many members each set of x has in common with each of y: occurrences, multiplied column block by column block."""
    both = np.concatenate([*x, *y])
    kinds, column, times = np.unique(both, return_inverse=True, return_counts=True)
    often = np.flatnonzero(times > 1)
    place = np.full(len(kinds), -1)
    place[often] = np.arange(len(often))
    column = place[column]
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(x), len(y)), np.float64)
    for begin in range(0, len(often), _COLUMNS):
        at = slice(*np.searchsorted(column, [begin, begin + _COLUMNS]))
        has = np.zeros((len(x) + len(y), _COLUMNS), np.float32)
        has[row[at], column[at] - begin] = 1
        out += has[: len(x)] @ has[len(x) :].T
    return out.astype(np.int64)


def _links_of_block(t: pa.Table, least: list[int], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the components of a block, whose members are in parts ``i`` and ``j`` of a band."""
    block, i, j, slot = t["block"].to_numpy(), t["i"][0].as_py(), t["j"][0].as_py(), t["slot"][0].as_py()
    signature = _as_matrix(t["signature"].combine_chunks())
    node, root, size = (t[c].to_numpy() for c in ("node", "root", "n_shingles"))
    x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
    found = []
    for part in np.array_split(x, max(1, len(x) // 64)):
        u, v = np.repeat(part, len(y)), np.tile(y, len(part))
        small, large = np.minimum(size[u], size[v]), np.maximum(size[u], size[v])
        fits = (node[u] < node[v]) if i == j else np.ones(len(u), bool)
        fits &= (root[u] != root[v]) & (100 * small >= percent * large)
        u, v = u[fits], v[fits]
        stays, matches = _may_be_alike(signature[u], signature[v], least)
        u, v = u[stays], v[stays]
        new = _first_shared(signature[u], signature[v]) == slot
        found.append((u[new], v[new], matches[new]))
    u, v, matches = (np.concatenate(c) for c in zip(*found, strict=True))
    if not len(u):
        return node[:0], node[:0]
    members = [np.frombuffer(m.as_buffer(), np.uint64) for m in t["members"]]
    own_u, at_u = np.unique(u, return_inverse=True)
    own_v, at_v = np.unique(v, return_inverse=True)
    if len(u) > 200:
        shared = _shared([members[k] for k in own_u], [members[k] for k in own_v])[at_u, at_v]
    else:
        shared = [len(np.intersect1d(members[a], members[b], assume_unique=True)) for a, b in zip(u, v, strict=True)]
    linked = 100 * np.array(shared) >= percent * (size[u] + size[v] - shared)
    parent = {r: r for r in root.tolist()}

    def top(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    kept = []
    for k in np.flatnonzero(linked).tolist():
        a, b = top(int(root[u[k]])), top(int(root[v[k]]))
        if a != b:
            parent[a] = b
            kept.append(k)
    return node[u[kept]], node[v[kept]]


def _links_apart(members: DataFrame, least: list[int], percent: int) -> DataFrame:
    """``a, b``: links between different roots of each group of ``band, i, j``; the rows come in that order."""
    keys = ("band", "i", "j")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            edge = np.zeros(max(0, batch.num_rows - 1), bool)
            for column in keys:
                k = batch.column(column).to_numpy()
                edge |= k[1:] != k[:-1]
            cuts = [0, *(np.flatnonzero(edge) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and any(held[-1].column(c)[0] != batch.column(c)[a] for c in keys):
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield pa.Table.from_batches(held)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(b for b in batches if b.num_rows):
            a, b = _links_of_block(t.combine_chunks(), least, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return members.mapInArrow(link, "a long, b long")


def _rooted(docs: DataFrame, signed: DataFrame, shingle_words: int, percent: int, miss: float, block: int) -> DataFrame:
    """The rows of ``signed`` with ``root``, the least node reachable over links; null for a row without shingles."""
    spark = docs.sparkSession
    least = least_matches(percent / 100, miss)
    nodes = signed.filter("node is not null")

    bands = nodes.select(F.posexplode("bands").alias("slot", "band"), "node")
    several = bands.groupBy("band").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("band")
    members = stored(bands.join(several, "band").select("band", "slot", "node").distinct())
    counts = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    met = members.join(counts, "band").groupBy("node").agg(F.sum("n").alias("met"))
    hubs = members.join(met, "node").groupBy("band").agg(F.max(F.struct("met", "node")).alias("hub"))
    spokes = stored(members.join(hubs.select("band", F.col("hub.node").alias("hub")), "band").filter("node <> hub"))

    candidates = met.select("node")
    one_each = nodes.select("node", "n_shingles", "signature").join(candidates, "node", "left_semi")
    one_each = stored(one_each.dropDuplicates(["node"]))
    full = _full_sets(docs, signed, candidates, shingle_words)
    tested = spokes.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    links = stored(_verified(_compared(tested, one_each, percent, least), full, percent))
    roots = components(links)

    apart = spokes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = stored(apart.select("band", "slot", "node", "root"))
    still = apart.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("band")
    within = apart.join(still, "band").join(one_each.select("node", "n_shingles"), "node")
    run = Window.partitionBy("band").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.coalesce(F.sum(F.greatest("n_shingles", F.lit(LEAST))).over(run), F.lit(0))
    within = within.withColumn("block", F.floor(weight / block).cast("int"))
    within = within.withColumn("blocks", F.max("block").over(Window.partitionBy("band")))
    dealt = within.withColumn("with", F.explode(F.sequence(F.lit(0), "blocks"))).drop("n_shingles")
    dealt = dealt.join(one_each, "node").join(full, "node").select(
        "band",
        F.least("block", "with").alias("i"),
        F.greatest("block", "with").alias("j"),
        "slot",
        "block",
        "node",
        "root",
        "n_shingles",
        "signature",
        "members",
    )
    dealt = dealt.repartition(partitions(spark), "band", "i", "j").sortWithinPartitions("band", "i", "j")
    more = stored(_links_apart(dealt, least, percent))
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    return signed.drop("signature", "bands").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(
    docs: DataFrame, shingle_words: int = 5, percent: int = 80, miss: float = 1e-6, block: int = BLOCK
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Two documents are linked if 100 * shared >= percent * all of their distinct shingles of ``shingle_words`` words, runs of
    anything but ASCII white space with A-Z lower-cased; fewer words are one shingle. The component is the least id reachable
    over links; the document of that id is kept. ``miss`` is the chance that signatures rule out a true link.

    Null and empty texts have no shingles and no links; rows that share an id count as one document; null ids are one id,
    the least; other columns are not read; an empty table gives no rows.
    """
    signed = stored(_signed(docs, shingle_words))
    rooted = _rooted(docs, signed, shingle_words, percent, miss, block)
    smallest = rooted.filter("root is not null").groupBy("root").agg(F.min("key").alias("component"))
    result = rooted.join(smallest, "root", "left").withColumn("component", F.coalesce("component", "key"))
    as_id = lambda c: F.when(F.col(c) != FIRST_KEY, F.col(c))
    return result.select(
        as_id("key").alias("doc_id"),
        "n_shingles",
        as_id("component").alias("component_id"),
        (F.col("key") == F.col("component")).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, shingle_words: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """The documents with all their columns, one row of each component of :func:`near_duplicates`.

    Rows are decided one by one, whatever ids they share: the row of the least id stays, null being the least, then the one
    of the least hashes; of rows equal in all any one. Rows without shingles are alike to none and stay.
    """
    at = F.monotonically_increasing_id()
    rows = stored(docs.select(at.alias("at"), whole_row(docs).alias("row")))
    columns = [F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind]  # maps have no hash
    texts = rows.select("row.doc_id", "row.text", "at", F.xxhash64(*columns).alias("hashed"))
    signed = stored(_signed(texts, shingle_words, "at", "hashed"))
    rooted = _rooted(texts, signed, shingle_words, percent, miss, BLOCK).filter("root is not null")
    one = rooted.groupBy("root").agg(F.min(F.struct("key", "node", "hashed", "at")).alias("one"))
    one = stored(one)  # both sides of the join are dealt anew: a hot root is split
    gone = rooted.join(one, "root").filter("at <> one.at").select("at")
    return rows.join(gone, "at", "left_anti").select("row.*")
