"""N-gram Jaccard join: grouped prefix join over sets of word shingles.

1. Shingles that many documents share are found from counts that every task takes of its own documents, and form a
   list of bounded size. The shingles of a set are ordered by that count (0 for all others), then by hash, so a
   passage that many documents share stands at the end. Any list gives right results; a good one gives few candidates.
2. Documents with the same set become one class, classes with the same size and the same prefix one group.
3. Groups that share a prefix shingle meet in its bucket, unless no other there is near enough in size; large buckets are
   cut into blocks. Group pairs pass the size and the position bound; their members the bound that the parity bitmaps of
   two sets put on their difference.
4. A class is named by the digest of its set. Round one verifies, for every class, two partners: the nearest by bitmap
   and the one with most partners of its own, and takes connected components. Round two verifies all candidates
   between different components. What both leave out cannot change a component, so a group of near copies is not
   paired out.

Stated cases: a null text, or one without words, has an empty set and links with nothing; documents without an id get
their set's size, no component, and link with nothing; rows that share an id are one document of the link graph;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatum.llm.common import components, slices, typed
from probatum.llm.shingles import mix, shingle_sets
from probatum.session import cut_lineage

BITS = 512  # of a parity bitmap
BLOCK = 1024  # groups of a bucket that meet in one task
MEMBERS = 256  # classes of a group in one row, where a group is large
FREQUENT_SHARE = 1e-3  # of the documents
FREQUENT_MOST = 1 << 20  # entries of the list of frequent shingles, 16 MB
CHUNK = 1 << 22  # shingles a task counts at once
PAIRS = 1 << 20  # pairs compared at once
BLOOM_BITS = 1 << 26


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column(batch.num_columns - 1).to_pylist()


def frequent_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles in a large share of all documents, sorted by hash.

    A shingle in that share of all documents is in that share of some task's, so counting it there sees it.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, docs_seen = [], 0, 0

        def counted() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            often = counts >= max(2, FREQUENT_SHARE * docs_seen)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.append(keys[often].view(np.int64), 0)), pa.array(np.append(counts[often], 0)),
                 pa.array(np.append(np.zeros(int(often.sum()), np.int64), docs_seen))], names=["token", "n", "docs"])

        for batch in slices(batches, -1):
            sets = [s for s in shingle_sets(_texts(batch), width) if len(s)]
            held += sets
            docs_seen += len(sets)
            size += sum(map(len, sets))
            if size > CHUNK:
                yield counted()
                held, size, docs_seen = [], 0, 0
        yield counted()

    counts = cut_lineage(docs.select("text").mapInArrow(work, "token bigint, n bigint, docs bigint").groupBy("token").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    total = counts.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    top = counts.filter(F.col("n") >= max(30, FREQUENT_SHARE * total)).orderBy(F.desc("n"), "token").limit(FREQUENT_MOST).select("token", "n").toPandas()
    keys = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top["n"].to_numpy(np.int64)[order]


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n, (d1, d2) digest of the set, (p1, p2) digest of its prefix, prefix, bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, width))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value

        for batch in slices(batches, -1):
            rows = []
            for s in shingle_sets(_texts(batch), width):
                n = len(s)
                if not n:
                    rows.append((0, 0, 0, 0, 0, np.zeros(0, np.int64), b""))
                    continue
                often = np.zeros(n, np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    often = np.where(keys[at] == s, counts[at], 0)
                prefix = s[np.lexsort((s, often))][: n + (-percent * n // 100) + 1]
                bits = np.packbits((np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8))
                rows.append((n, *_digest(s), *_digest(prefix), prefix.view(np.int64), bits.tobytes()))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.list_(pa.int64())), pa.array(columns[6], pa.binary())],
                names=["doc_id", "n", "d1", "d2", "p1", "p2", "prefix", "bitmap"])

    kinds = "doc_id bigint, n bigint, d1 bigint, d2 bigint, p1 bigint, p2 bigint, prefix array<bigint>, bitmap binary"
    return docs.select("doc_id", "text").mapInArrow(work, kinds)


def grouped(classes: DataFrame) -> DataFrame:
    """Classes (cls, n, p1, p2) with ``gid``: the smallest class of those with equal size and prefix. Large groups are split.

    At most 10,000 groups hold more than a ten-thousandth of all classes, so only their keys are broadcast.
    """
    key = ["n", "p1", "p2"]
    sizes = classes.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    most = max(MEMBERS, classes.count() // 10_000)
    large = sizes.filter(F.col("size") > most).select(*key, F.ceil(F.col("size") / MEMBERS).alias("cuts"))
    cut = classes.join(F.broadcast(large), key, "left").withColumn("cut", F.coalesce(F.pmod(F.xxhash64("cls"), F.col("cuts")), F.lit(0)))
    leaders = cut.groupBy(*key, "cut").agg(F.min("cls").alias("gid"))
    return cut.join(leaders, [*key, "cut"]).select("cls", "rep", "gid")


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): 0 repeated counts[0] times beside 0, 1, ..., then 1 likewise."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def _candidates(batches: Iterator[pa.RecordBatch], percent: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Bucket rows, sorted by bucket, to candidate pairs; a bucket may go on in the next batch.

    With ``every``, all of them, a < b. Otherwise, for every class, its nearest partner in the bucket (kind 0, with the
    bitmaps' distance as rank) and its partner with most partners there (kind 1, with minus their number as rank).
    """
    fields = ["a", "b", "kind", "rank"]

    def best(a: np.ndarray, b: np.ndarray, at: np.ndarray, rank: np.ndarray, kind: int) -> pa.RecordBatch:
        order = np.lexsort((b, rank, a, at))
        a, b, at, rank = a[order], b[order], at[order], rank[order]
        keep = np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1])])
        return pa.RecordBatch.from_arrays(
            [pa.array(a[keep]), pa.array(b[keep]), pa.array(np.full(int(keep.sum()), kind, np.int32)), pa.array(rank[keep].astype(np.int32))], names=fields)

    def pairs_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket = np.stack([t.column(c).to_numpy() for c in ("token", "i", "j")])
        block, n, pos = (t.column(c).to_numpy() for c in ("block", "n", "pos"))
        members = t.column("members").combine_chunks()
        first = members.offsets.to_numpy().astype(np.int64)
        size, first = np.diff(first), first[:-1] - first[0]
        flat = members.flatten()
        rep, root = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("rep", "root"))
        bits = np.frombuffer(b"".join(flat.field("bitmap").to_pylist()), np.uint64).reshape(len(rep), BITS // 64)
        change = np.flatnonzero((bucket[:, 1:] != bucket[:, :-1]).any(axis=0)) + 1
        end = np.repeat(np.append(change, len(n)), np.diff(np.concatenate([[0], change, [len(n)]])))
        own = bucket[1] == bucket[2]
        # partners of a row: itself, where it has several members and the bucket is its own, and all behind it
        count = end - np.arange(len(n))
        start = 0
        while start < len(n):
            stop = start + max(1, int(np.searchsorted(np.cumsum(count[start:]), PAIRS)))
            which, place = _ranges(count[start:stop])
            x, y = which + start, which + start + place
            ok = (own[x] | (block[x] != block[y])) & ((x != y) | (own[x] & (size[x] > 1)))
            x, y = x[ok], y[ok]
            need = -(-percent * (n[x] + n[y]) // (100 + percent))
            ok = (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (1 + np.minimum(n[x] - pos[x], n[y] - pos[y]) - 1 >= need)
            x, y, need = x[ok], y[ok], need[ok]
            begin = 0
            while begin < len(x):
                cells = size[x[begin:]] * size[y[begin:]]
                last = begin + max(1, int(np.searchsorted(np.cumsum(cells), PAIRS)))
                which, place = _ranges(cells[: last - begin])
                gx, gy = x[begin:last][which], y[begin:last][which]
                a, b = first[gx] + place // size[gy], first[gy] + place % size[gy]
                ok = root[a] != root[b]
                a, b, gx, gy, limit = a[ok], b[ok], gx[ok], gy[ok], (n[gx] + n[gy] - 2 * need[begin:last][which])[ok]
                far = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
                ok = (far <= limit) & (rep[a] != rep[b])
                a, b, at, far = rep[a[ok]], rep[b[ok]], end[gx[ok]], far[ok]
                if every and len(a):
                    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                    zero = pa.array(np.zeros(len(both), np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), zero, zero], names=fields)
                elif len(a):
                    a, b, at, far = np.append(a, b), np.append(b, a), np.append(at, at), np.append(far, far)
                    yield best(a, b, at, far, 0)
                    _, which, degree = np.unique(np.stack([at, b], 1), axis=0, return_inverse=True, return_counts=True)
                    yield best(a, b, at, -degree[which.ravel()], 1)
                begin = last
            start = stop

    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        bucket = np.stack([held.column(c).to_numpy() for c in ("token", "i", "j")])
        change = np.flatnonzero((bucket[:, 1:] != bucket[:, :-1]).any(axis=0))
        if len(change) and held.num_rows >= 2 * BLOCK:
            done = int(change[-1]) + 1
            yield from pairs_of(held.slice(0, done).combine_chunks())
            held = held.slice(done).combine_chunks()
    if held is not None and held.num_rows:
        yield from pairs_of(held.combine_chunks())


def shared_tokens(spread: DataFrame, percent: int) -> DataFrame:
    """(gid, token, pos, count) of the rows (token, pos, gid, n) that meet another in their bucket, with its row count.

    Sets of sizes too far apart cannot be similar, so a row without a neighbour in order of size that is near enough goes.
    """
    bucket = Window.partitionBy("token")
    by_size = bucket.orderBy("n")

    def near(n: Column) -> Column:
        return n.isNotNull() & (100 * F.least("n", n) >= percent * F.greatest("n", n))

    sized = spread.withColumns({"below": F.lag("n").over(by_size), "above": F.lead("n").over(by_size)})
    counted = sized.withColumn("count", F.count(F.lit(1)).over(bucket))
    return counted.filter(near(F.col("below")) | near(F.col("above"))).select("gid", "token", "pos", "count")


def candidate_pairs(members: DataFrame, tokens: DataFrame, roots: DataFrame | None, percent: int) -> DataFrame:
    """Candidate pairs of classes (a < b), distinct. With roots, all those between different components."""
    if roots is None:
        rooted = members.withColumn("root", F.col("cls"))
    else:
        rooted = members.join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls")).drop("node")
        spread = rooted.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        still = tokens.join(spread, "gid").groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("token")
        tokens = tokens.join(still, "token")
    wanted = tokens.select("gid").distinct()
    rows = rooted.join(wanted, "gid").groupBy("gid", "n").agg(F.collect_list(F.struct(F.col("cls").alias("rep"), "root", "bitmap")).alias("members"))
    blocks = F.ceil(F.col("count") / BLOCK).cast("bigint")
    dealt = (
        tokens.withColumn("block", F.pmod(F.xxhash64("gid"), blocks))
        .select("gid", "token", "pos", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("other"))
        .select("gid", "token", "pos", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    bucket_rows = dealt.join(rows, "gid").select("token", "i", "j", "block", "n", "pos", "members")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = bucket_rows.repartition(n, "token", "i", "j").sortWithinPartitions("token", "i", "j")
    every = roots is not None
    found = placed.mapInArrow(lambda it: _candidates(it, percent, every), "a bigint, b bigint, kind int, rank int")
    if every:
        return found.select("a", "b").distinct()
    chosen = found.groupBy("a", "kind").agg(F.min(F.struct("rank", "b"))["b"].alias("b"))
    return chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def bloom(keys: DataFrame) -> np.ndarray:
    """One bit per hashed key, in a bitmap of fixed size (8 MB), for filtering rows before a join on the key."""
    slot = F.pmod(F.xxhash64(keys.columns[0]), F.lit(BLOOM_BITS))
    words = (keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 as int))")).alias("bits")).toPandas())
    out = np.zeros(BLOOM_BITS // 32, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def _digest(x: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set of hashes."""
    a, b = mix(x), mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return a.sum(dtype=np.uint64).view(np.int64).item(), np.bitwise_xor.reduce(b).view(np.int64).item()


def _packed(s: np.ndarray) -> bytes:
    """The upper 48 bits of every hash. Two sets of a thousand share one by chance once in 300 million pairs."""
    return s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(">u8").ravel().astype(np.uint64)


def _parity(s: np.ndarray) -> bytes:
    """A parity bitmap with a bit or more per member."""
    size = max(256, 1 << int(len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """The sets of two parity bitmaps differ by this many members at least. The longer map is folded to the shorter."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(p) > len(q):
        p, q = q, p
    q = np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0)
    return int(np.bitwise_count(p ^ q).sum())


def _met(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, form, keep) -> DataFrame:
    """Pairs for which ``keep`` holds on what ``form`` makes of their sets, made again from one text of each class.

    A bitmap of the ids wanted keeps all other texts from being hashed, and no text is shuffled; forms meet their pairs by
    the sets' digests, so one that nobody asked for meets none.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "rep"), "cls").select(F.col("rep").alias("doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(bloom(wanted.distinct()))

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, -1):
            slot = batch.column(0).to_numpy()
            hit = (shared.value[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1)
            made = [s for s in shingle_sets(_texts(batch.filter(pa.array(hit.astype(bool)))), width) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(s)[0] for s in made], pa.int64()), pa.array([len(s) for s in made], pa.int64()), pa.array([form(s) for s in made], pa.binary())], names=["id", "n", "form"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, -1):
            ok = [keep(*row) for row in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    slots = docs.filter("doc_id is not null").select(F.pmod(F.xxhash64("doc_id"), F.lit(BLOOM_BITS)).alias("slot"), "text")
    made = slots.mapInArrow(forms, "id bigint, n bigint, form binary").dropDuplicates(["id"])
    both = pairs.join(made.toDF("a", "n_a", "form_a"), "a").join(made.toDF("b", "n_b", "form_b"), "b")
    return both.select("a", "b", "n_a", "n_b", "form_a", "form_b").mapInArrow(compare, "a bigint, b bigint")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough.

    Parity bitmaps with a bit per member come first: they bound the difference of two sets from below, at a fiftieth of
    the sets' size. The pairs that they leave are decided by the sets.
    """
    def possible(n: int, m: int, x: bytes, y: bytes) -> bool:
        need = -(-percent * (n + m) // (100 + percent))  # members that both have to share
        return _apart(x, y) <= n + m - 2 * need

    def similar(n: int, m: int, x: bytes, y: bytes) -> bool:
        both = np.concatenate([_unpacked(x), _unpacked(y)])
        both.sort()
        same = int((both[1:] == both[:-1]).sum())
        return 100 * same >= percent * (n + m - same)

    near = cut_lineage(_met(pairs, docs, classes, width, _parity, possible))
    return _met(near, docs, classes, width, _packed, similar)


def jaccard_components(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked by sets with a Jaccard similarity of percent / 100 or more."""
    docs = typed(documents, doc_id="bigint", text="string")
    # prefixes and bitmaps are on disk only until the classes have theirs
    signed = signatures(docs, width, percent).persist(StorageLevel.DISK_ONLY)
    class_key = ["n", "d1", "d2"]
    found = cut_lineage(signed.select("doc_id", *class_key, "p1", "p2"))
    linkable = found.filter("n > 0 and doc_id is not null")
    classes = cut_lineage(linkable.groupBy(*class_key, "p1", "p2").agg(F.min("doc_id").alias("rep")).withColumn("cls", F.col("d1")))
    placed = grouped(classes)
    # rows of one document that are equal meet where the join has put them, so prefixes are not shuffled again
    members = cut_lineage(signed.filter("n > 0 and doc_id is not null").select("doc_id", "d1", "n", "prefix", "bitmap")
                          .join(placed, (F.col("doc_id") == F.col("rep")) & (F.col("d1") == F.col("cls"))).dropDuplicates(["doc_id", "d1"])
                          .select("cls", "gid", "n", "bitmap", F.when(F.col("cls") == F.col("gid"), F.col("prefix")).alias("prefix")))
    signed.unpersist()
    sizes = members.groupBy("gid").agg(F.count(F.lit(1)).alias("m"))
    several = sizes.filter("m > 1")
    # a bucket is a prefix shingle; a group that holds several classes also has a bucket of its own, named by its gid
    spread = members.filter("prefix is not null").select(F.posexplode("prefix").alias("pos", "token"), "gid", "n")
    shared = shared_tokens(spread, percent)
    inner = several.select("gid", F.col("gid").alias("token"), F.lit(0).alias("pos"), F.lit(1).cast("bigint").alias("count"))
    tokens = shared.unionByName(inner).persist(StorageLevel.DISK_ONLY)
    near = cut_lineage(candidate_pairs(members, tokens, None, percent))
    first = cut_lineage(verified(near, docs, classes, width, percent))
    more = cut_lineage(candidate_pairs(members, tokens, components(first), percent).join(near, ["a", "b"], "left_anti"))
    tokens.unpersist()
    links = first.unionByName(verified(more, docs, classes, width, percent))
    # the links' ends become their classes' smallest ids
    of_class = classes.select("cls", "rep")
    named = (links.join(of_class.toDF("a", "x"), "a").join(of_class.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    copies = linkable.select(*class_key, "doc_id").join(classes.select(*class_key, "rep"), class_key)
    copy_links = copies.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    joined = components(named.unionByName(copy_links))
    return (found.select("doc_id", F.col("n").alias("n_shingles")).join(joined, F.col("doc_id") == F.col("node"), "left")
            .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")))
