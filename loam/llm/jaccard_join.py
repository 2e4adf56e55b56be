"""Operator 1: n-gram Jaccard join by a grouped prefix join.

Texts become sets of hashed word shingles; texts with equal sets become one *node* (its id: the
smallest doc_id). In one total order of the shingles, two sets that reach the threshold share a
shingle within their prefixes, the first ``n - ceil(t n) + 1`` shingles. Nodes of identical size and
prefix form one *group*; the join runs on groups:

1. postings ``(shingle, group, size, position)`` for the shingles that several groups' prefixes hold;
2. group pairs that share a posting pass the size filter and the pair's own prefix lengths;
3. surviving group pairs are expanded to their members. Each set has bits, as many as shingles, that say
   whether an odd number of its shingles hashes there: sets differ by as many shingles at least as bits. Pairs
   for which that leaves the threshold within reach are compared exactly, by their whole sets. Both are done
   in lots, so that what a test shuffles stays in proportion to the table, whatever the number of pairs.

Pairs of postings of at most ``SHORT`` nodes are formed so. In longer ones, and within groups, the
pairs would grow with the square of a cluster. They are *recentred* instead. The centre L of a posting is the
majority of a few of its sets: the passage that they have in common. Of a set x only the difference
from L counts, R = L - x and A = x - L, as

    |x & y| = |L| - |Rx| - |Ry| + |Rx & Ry| + |Ax & Ay|.

With ``s(x) = (1 + t) |Rx| + t |x|`` (times 100, in whole numbers) x and y link for certain where
``s(x) + s(y) <= (1 + t) |L|``, and otherwise only if their differences share at least
``(s(x) + s(y)) / (1 + t) - |L|`` shingles. So everything near enough to the set of least s links with
it, and all other links lie between sets that share a shingle of the prefixes of their *differences*:
new, shorter postings, worked off alike. (The first postings are those of an empty centre.) Postings of
at most ``SMALL`` rows, or whose differences would fill more rows than they have pairs, are enumerated; where sizes
alone show that (a centre that is small beside its sets), no text travels for it. A round is dozens of queries, so the
rounds end once all long postings together have no more pairs than ``LEFT`` for each document: these are enumerated.
Nothing is capped; any centre and any order give the same links.

The order of shingles is (weight, hash). Weights are counts of shingles that are frequent within a
stretch of one task's documents, summed over the corpus; all others weigh 0. Common passages so come
last, outside prefixes. The weights only keep postings short, and the ``ORDERED`` heaviest are kept, a
fixed bound for what is broadcast.

Rows without words have an empty set and link with nothing. Rows with a null doc_id link with
nothing and have a null component. Rows that share a doc_id count as one vertex. Shingles are compared
as 64-bit hashes, node identity as 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import Workspace
from loam.llm.components import connected_components
from loam.llm.shingles import mix, shingle_sets, text_buffers

#: Shingles with a weight that are broadcast at most (16 bytes each).
ORDERED = 200_000
#: Shingles a task holds before it counts them, and the count within them from which one has a weight.
STRETCH, LOCAL = 2_000_000, 3
_SALT = np.uint64(0x632BE59BD9B4E019)
#: Bits of the largest bitmap that spares texts a shuffle (8 MB), and its bits for each id.
BITS, SPREAD = 1 << 26, 32
#: Bits of a set's parities at least; larger sets have as many as shingles, to the next power of two.
PARITY = 1024
#: Candidate pairs, and shingles of pairs, that are tested at once, and rows that are recentred at once, at least; larger
#: tables take as many pairs as documents, half their shingles, and a quarter of their documents.
LOT, SHINGLES, CENTRED = 300_000, 60_000_000, 50_000
#: Nodes of a posting whose group pairs are formed at once, and rows of one that isn't recentred.
SHORT, SMALL = 8, 32
#: Pairs for each document up to which all that is left in long postings is enumerated, which ends the rounds.
LEFT = 16
#: Sets whose majority is a centre.
SAMPLE = 9
#: Links that a label travels between rounds.
STEPS = 3
#: Parts of the shingles whose postings are formed one after the other, so that only one part is on disk at once.
PARTS = 4
#: Packed texts that a task opens at once.
OPENED = 64


def _frequent(k: int):
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= LOCAL
            return pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(count[often].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for s in shingle_sets(batch.column(0), k):
                held.append(s)
                size += len(s)
                if size >= STRETCH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return tally


def prefix_length(n, percent: int):
    """Of a set of n: sets that reach the threshold share a shingle within so many first ones."""
    return n - (percent * n + 99) // 100 + 1


def _weights(s: np.ndarray, order: np.ndarray, weight: np.ndarray) -> np.ndarray:
    if not len(order):
        return np.zeros(len(s), np.int64)
    slot = np.minimum(np.searchsorted(order, s), len(order) - 1)
    return np.where(order[slot] == s, weight[slot], 0)


def _sketch(k: int, percent: int, order: np.ndarray, weight: np.ndarray):
    """doc_id, size, 128-bit fingerprint, ordered prefix (with a fingerprint) and parities of each text's set."""

    def prefix(s: np.ndarray) -> np.ndarray:
        want = prefix_length(len(s), percent)
        w = _weights(s, order, weight)
        light = s[w == 0]
        if len(light) >= want:
            return light[:want]
        rest, w = s[w > 0], w[w > 0]
        return np.concatenate([light, rest[np.lexsort((rest, w))][: want - len(light)]])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, one, two, h1, h2, prefixes, odd, at = [], [], [], [], [], [], [], [0]
            for s in shingle_sets(batch.column(1), k):
                sizes.append(len(s))
                bits = max(PARITY, 1 << max(0, len(s) - 1).bit_length())
                odd.append(np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1).astype(bool)))
                one.append(s.sum(dtype=np.uint64))
                two.append(mix(s + _SALT).sum(dtype=np.uint64))
                prefixes.append(prefix(s) if len(s) else s)
                h1.append(prefixes[-1].sum(dtype=np.uint64))
                h2.append(mix(prefixes[-1] + _SALT).sum(dtype=np.uint64))
                at.append(at[-1] + len(prefixes[-1]))
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.array(sizes, np.int64)),
                    *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two, h1, h2)],
                    pa.ListArray.from_arrays(pa.array(np.array(at, np.int32)), pa.array(flat.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(o) // 8 for o in odd)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.uint8), *odd]).view(np.int64))),
                ],
                names=["doc_id", "n", "f1", "f2", "h1", "h2", "prefix", "odd"],
            )

    return sketch


def _bitmap(slots: DataFrame, size: int) -> np.ndarray:
    """The bits of slots: at most size / 64 rows come to the driver, whatever the number of ids."""
    words = slots.groupBy(F.expr("s div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out


def _among(df: DataFrame, ids: DataFrame, column: str, build, schema: str) -> DataFrame:
    """df's rows whose ``column`` is among ids (distinct), as ``build`` turns their batches.

    Up to BITS / SPREAD ids rows are filtered where they lie, by a Bloom filter in the same Python worker
    that builds; the few others that pass come along and find no partner in the joins that follow.
    Beyond, the filter would fill up, and the rows are joined.
    """
    n = ids.count()
    if n > BITS // SPREAD:
        return df.join(ids.select(column), column, "left_semi").select(df.columns).mapInArrow(lambda batches: map(build, batches), schema)
    size = max(1 << 16, 1 << (max(1, n) * SPREAD - 1).bit_length())
    slot = lambda turn: F.pmod(F.xxhash64(column, F.lit(turn)), F.lit(size))
    slots = ids.select(F.explode(F.array(slot(0), slot(1))).alias("s"))
    bits, columns = df.sparkSession.sparkContext.broadcast(_bitmap(slots, size)), df.columns

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for turn in (1, 2):
                at = batch.column(batch.num_columns - turn).to_numpy()
                keep &= (bits.value[at >> 6] >> (at & 63)) & 1 == 1
            if keep.any():
                yield build(batch.select(columns).filter(pa.array(keep)))

    return df.withColumn("_slot0", slot(0)).withColumn("_slot1", slot(1)).mapInArrow(sift, schema)


def _packed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, packed) of the documents among ids: texts are filtered where they lie.

    A compressed text takes a third of the room of its set of hashes; the set is made again where it is compared.
    """

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = text_buffers(batch.column(1))
        codec = pa.Codec("zstd")
        raw = [data[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
        packed = [len(r).to_bytes(8, "little") + (codec.compress(r, asbytes=True) if r else b"") for r in raw]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    return _among(docs.where("doc_id is not null"), ids, "doc_id", build, "doc_id long, packed binary")


def _opened(packed: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sets of packed texts, in order."""
    codec = pa.Codec("zstd")
    for i in range(0, len(packed), OPENED):
        raw = [codec.decompress(p[8:], int.from_bytes(p[:8], "little"), asbytes=True) if len(p) > 8 else b"" for p in packed[i : i + OPENED]]
        yield from shingle_sets(pa.array(raw, pa.large_binary()).cast(pa.large_string()), k)


def _as_set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _majority(k: int):
    """(key, centre, set) of the sampled (key, packed) of one posting: what most of the sets hold."""

    def majority(sample: pa.Table) -> pa.Table:
        token, count = np.unique(np.concatenate(list(_opened(sample.column("packed").to_pylist(), k))), return_counts=True)
        core = token[2 * count > sample.num_rows]
        centre = mix(mix(core).sum(dtype=np.uint64, keepdims=True) + _SALT).view(np.int64)
        return pa.table({"key": sample.column("key")[:1], "centre": pa.array(centre), "set": pa.array([core.tobytes()], pa.binary())})

    return majority


def _differences(k: int, percent: int, order: np.ndarray, weight: np.ndarray):
    """(centre, x, n, d, s, t, least, tokens) of rows (centre, x, centre's set, x's packed text).

    d: shingles of the difference; s as in the module's docstring, t what s(x) + s(y) must not exceed to
    link for certain; least: shingles of the difference that any link shares, by x's size alone; tokens:
    as many of the difference's first shingles as any link can need.
    """
    whole = 100 + percent

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, tokens = [], []
            for p, own in zip(batch.column(2), _opened(batch.column(3).to_pylist(), k), strict=True):
                centre = _as_set(p)
                added = own[~np.isin(own, centre, assume_unique=True)]
                lost = centre[~np.isin(centre, own, assume_unique=True)]
                n, size, r, d = len(own), len(centre), len(lost), len(lost) + len(added)
                s, t = whole * r + percent * n, whole * size
                least = -(-percent * n // 100) - size + r
                need = max(1, least, -(-(s + percent * size - t) // whole))
                # what a set lacks of its centre is rarer than anything with a weight
                heavy = np.concatenate([2 * _weights(added, order, weight), np.ones(r, np.int64)])
                token = np.concatenate([added, mix(lost + _SALT)])
                numbers.append((n, d, s, t, least))
                tokens.append(token[np.lexsort((token, heavy))][: max(0, d - need + 1)])
            at = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
            flat = np.concatenate([*tokens, np.zeros(0, np.uint64)]).view(np.int64)
            columns = np.array(numbers, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(np.ascontiguousarray(c)) for c in columns], pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                names=["centre", "x", "n", "d", "s", "t", "least", "tokens"],
            )

    return differ


def _linked(k: int, percent: int):
    """The pairs (x, y) that link, of rows (x, y, x's packed text, y's); rows with one x or y lie together."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(0, batch.num_rows, OPENED):
                part = batch.slice(i, OPENED)
                left, right = part.column(2).to_pylist(), part.column(3).to_pylist()
                texts = list(dict.fromkeys(left + right))
                sets = dict(zip(texts, _opened(texts, k), strict=True))
                for p, q in zip(left, right, strict=True):
                    a, b = sets[p], sets[q]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return compare


def _near_labels(links: DataFrame) -> DataFrame:
    """(node, c) of linked nodes: the least node within ``STEPS`` links.

    Nodes of one label are connected; the rounds need no more than that, and the components proper are
    found once, at the end.
    """
    both = links.select(F.col("x").alias("node"), F.col("y").alias("to")).unionByName(links.select(F.col("y").alias("node"), F.col("x").alias("to")))
    labels = both.groupBy("node").agg(F.min("to").alias("c")).select("node", F.least("node", "c").alias("c"))
    for _ in range(STEPS - 1):
        met = both.join(labels.select(F.col("node").alias("to"), "c"), "to").select("node", "c").unionByName(labels)
        labels = met.groupBy("node").agg(F.min("c").alias("c"))
    return labels


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _group_pairs(postings: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of nodes whose groups share a posting and pass the filters."""
    need = F.expr(f"cast(ceil({percent} * (n + n2) / {100 + percent}.0D - 1e-9) as long)")
    fits = (F.expr(f"100 * least(n, n2) >= {percent} * greatest(n, n2)")) & (F.col("pos") < F.col("n") - need + 1) & (F.col("pos2") < F.col("n2") - need + 1)
    other = postings.select("token", F.col("g").alias("h"), F.col("n").alias("n2"), F.col("pos").alias("pos2"))
    pairs = postings.join(other, "token").where((F.col("g") < F.col("h")) & fits).select("g", "h").distinct()
    left, right = members.select("g", F.col("node").alias("x")), members.select(F.col("g").alias("h"), F.col("node").alias("y"))
    return pairs.join(left, "g").join(right, "h").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def _folded(bits: str, to: str) -> str:
    """The parities ``bits`` as they would be with as many bits as ``to``, which has no more; both are powers of two."""
    return f"if(size({bits}) = size({to}), {bits}, transform(sequence(0, size({to}) - 1), i -> aggregate(sequence(i, size({bits}) - 1, size({to})), 0L, (acc, j) -> acc ^ {bits}[j])))"


def _within_reach(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y), with sizes n and n2, that sizes and parities leave within reach of the threshold."""
    odd = sketches.select("doc_id", "n", "odd")
    one = pairs.join(odd.select(F.col("doc_id").alias("x"), "n", "odd"), "x")
    two = one.join(odd.select(F.col("doc_id").alias("y"), F.col("n").alias("n2"), F.col("odd").alias("odd2")), "y")
    same = F.expr(f"if(size(odd) > size(odd2), struct({_folded('odd', 'odd2')} as a, odd2 as b), struct(odd as a, {_folded('odd2', 'odd')} as b))")
    differ = F.aggregate(F.zip_with(same["a"], same["b"], lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda sum_, bits: sum_ + bits)
    sizes = F.col("n") + F.col("n2")
    return two.where((100 + percent) * (sizes - differ) >= 2 * percent * sizes).groupBy("x", "y").agg(F.max("n").alias("n"), F.max("n2").alias("n2"))


def _in_lots(ws: Workspace, rows: DataFrame, keys: list[str], lots: int, step) -> list[DataFrame]:
    """``step`` of each lot of rows, by their keys, written one after the other; rows of one key stay together."""
    return [ws.table(step(rows.where(F.pmod(F.xxhash64(*keys), F.lit(lots)) == i) if lots > 1 else rows)) for i in range(lots)]


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: components of the links Jaccard >= percent / 100.

    docs: doc_id long, text string; other columns are ignored. k: words of a shingle.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    whole = 100 + percent

    tallies = docs.select("text").mapInArrow(_frequent(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    heavy = tallies.orderBy(F.desc("n"), "token").limit(ORDERED).toArrow()
    order = heavy["token"].to_numpy().view(np.uint64)
    by = np.argsort(order)
    order, weight = order[by], heavy["n"].to_numpy()[by]
    sketches = ws.table(docs.mapInArrow(_sketch(k, percent, order, weight), "doc_id long, n long, f1 long, f2 long, h1 long, h2 long, prefix array<long>, odd array<long>"))

    known = sketches.where("n > 0 and doc_id is not null")
    nodes = ws.table(known.groupBy("n", "f1", "f2", "h1", "h2").agg(F.min("doc_id").alias("node")))
    groups = known.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("g"), F.first("prefix").alias("prefix"))
    several = nodes.groupBy("n", "h1", "h2").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    groups = ws.table(groups.join(several, ["n", "h1", "h2"], "left").withColumn("m", F.coalesce("m", F.lit(1))))
    members = ws.table(nodes.join(groups.select("n", "h1", "h2", "g", "m"), ["n", "h1", "h2"]).select("g", "node", "n", "m"))
    # prefixes are in groups from here on
    marks = ws.table(sketches.select("doc_id", "n", "f1", "f2", "odd"))
    ws.drop(sketches)
    known = marks.where("n > 0 and doc_id is not null")
    n_docs, n_shingles = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    spread = groups.select("g", "n", "m", F.posexplode("prefix").alias("pos", "token"))
    # one number, to shuffle less: groups in the high half, nodes in the low one
    parts = []
    for part in range(PARTS):
        some = spread.where(F.pmod("token", F.lit(PARTS)) == part)
        shared = some.groupBy("token").agg(F.sum(F.expr("(1L << 32) + least(m, 1000)")).alias("held")).where(F.expr("held >> 32 > 1"))
        shared = shared.select("token", (F.col("held") % (1 << 32) > SHORT).alias("long"))
        at = some.select("token", "g", F.expr("(n << 32) + pos").alias("place")).join(shared.hint("shuffle_hash"), "token")
        parts.append(ws.table(at.select("token", "g", F.expr("place >> 32").alias("n"), F.expr("place % (1L << 32)").alias("pos"), "long")))
    postings = _all(parts)
    ws.drop(groups)

    links: list[DataFrame] = []  # (x, y), x < y
    candidates = [ws.table(_group_pairs(postings.where("not long"), members, percent))]

    # (key, x, n, d, pos, s, t) of the long postings and of groups with several members, whose centre is empty
    own = members.select("g", F.col("node").alias("x"), "n")
    by_token = postings.where("long").select(F.col("token").alias("key"), "g", "pos").join(own, "g").select("key", "x", "n", "pos")
    by_group = members.where("m > 1").select(F.xxhash64("g", F.lit("group")).alias("key"), F.col("node").alias("x"), "n", F.lit(0).cast("long").alias("pos"))
    rows = ws.table(by_token.unionByName(by_group).select("key", "x", "n", F.col("n").alias("d"), "pos", (percent * F.col("n")).alias("s"), F.lit(0).cast("long").alias("t")))
    ws.drop(*parts)
    texts, labels, turn = None, None, 0
    while not rows.isEmpty():
        done = [rows]
        at = rows.withColumn("c", F.col("x")) if labels is None else rows.join(labels.withColumnRenamed("node", "x"), "x", "left").withColumn("c", F.coalesce("c", "x"))
        keys = at.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum(F.xxhash64("x").cast("decimal(20,0)")).alias("all"))
        keys = ws.table(keys.where("m > 1 and lo < hi").select("key", "m", "all"))
        at = ws.table(at.join(keys.select("key", "m"), "key"))
        done += [keys, at]
        big = keys.where(F.col("m") > SMALL)
        left = big.agg(F.sum(F.expr("cast(m as decimal(38,0)) * (m - 1) div 2"))).first()[0] or 0
        few, rows = at.where(F.col("m") <= SMALL) if left > LEFT * n_docs else at, None
        if left > LEFT * n_docs:
            # of postings with the same rows one is enough
            classes = ws.table(big.join(big.groupBy("m", "all").agg(F.min("key").alias("rep")), ["m", "all"]).select("key", "m", "rep"))
            done.append(classes)
            asked = ws.table(at.select("key", "x").join(classes.where("key = rep").select("key"), "key"))
            if texts is None:
                texts = ws.table(_packed(docs, ws.table(asked.select(F.col("x").alias("doc_id")).distinct())).select(F.col("doc_id").alias("x"), "packed").dropDuplicates(["x"]))
            lot = F.struct(F.xxhash64(F.lit(turn), F.lit("lot"), "x").alias("o"), "x")
            sample = asked.groupBy("key", F.pmod(F.xxhash64(F.lit(turn), "x"), F.lit(SAMPLE)).alias("slot")).agg(F.min(lot)["x"].alias("x"))
            centres = ws.table(sample.select("key", "x").join(texts, "x").select("key", "packed").groupBy("key").applyInArrow(_majority(k), "key long, centre long, set binary"))
            of_key = ws.table(classes.join(centres.select(F.col("key").alias("rep"), "centre"), "rep"))
            of_centre = ws.table(asked.join(centres.select("key", "centre"), "key").select("centre", "x").distinct())
            cores = centres.groupBy("centre").agg(F.first("set").alias("core"))
            costs = of_key.groupBy("centre").agg(F.sum(F.expr("m * (m - 1) div 2")).alias("pairs"))
            # a set of n has at least so many shingles of its difference from a centre of size in the new postings
            least = F.expr(f"greatest(0, least(n - size, n - cast(ceil({percent} * n / 100.0D) as long)))")
            sized = of_centre.join(at.groupBy("x").agg(F.max("n").alias("n")), "x").join(cores.select("centre", (F.length("core") / 8).cast("long").alias("size")), "centre")
            poor = ws.table(sized.groupBy("centre").agg(F.sum(least).alias("rows")).join(costs, "centre").where("rows >= 2 * pairs").select("centre"))
            few = few.unionByName(at.join(of_key.join(poor, "centre").select("key"), "key", "left_semi"))
            pairs = ws.table(of_centre.join(poor, "centre", "left_anti"))
            moved = lambda lot: lot.join(texts, "x").join(cores, "centre").select("centre", "x", "core", "packed").mapInArrow(_differences(k, percent, order, weight), "centre long, x long, n long, d long, s long, t long, least long, tokens array<long>")  # noqa: B023, E731
            differing = _in_lots(ws, pairs, ["centre", "x"], max(1, -(-pairs.count() // max(CENTRED, n_docs // 4))), moved)
            differ = _all(differing)
            nearest = differ.groupBy("centre").agg(F.min(F.struct("s", "x")).alias("o")).select("centre", F.col("o.s").alias("s0"), F.col("o.x").alias("x0"))
            sure = F.col("s") + F.col("s0") <= F.col("t")
            slack = F.when(sure, F.col("s") - F.col("s0") + 1).otherwise(F.col("s") + F.col("s0") - F.col("t"))
            need = F.greatest(F.lit(1).cast("long"), F.col("least"), F.ceil(slack / whole))
            found = ws.table(differ.join(nearest, "centre").select("centre", "x", "n", "d", "s", "t", "x0", sure.alias("sure"), F.slice("tokens", 1, F.greatest(F.lit(0), F.col("d") - need + 1).cast("int")).alias("tokens")))
            ws.drop(*differing)
            links.append(ws.table(found.where("sure and x <> x0").select(F.least("x", "x0").alias("x"), F.greatest("x", "x0").alias("y")).distinct()))
            filled = found.groupBy("centre").agg(F.sum(F.size("tokens")).alias("rows"))
            dear = costs.join(filled, "centre").where("rows >= pairs").select("centre")
            few = few.unionByName(at.join(of_key.join(dear, "centre").select("key"), "key", "left_semi"))
            fresh = found.join(dear, "centre", "left_anti").select("centre", "x", "n", "d", "s", "t", F.posexplode("tokens").alias("pos", "token"))
            fresh = ws.table(fresh.select(F.xxhash64("centre", "token").alias("key"), "x", "n", "d", F.col("pos").cast("long").alias("pos"), "s", "t"))
            rows = ws.table(fresh.join(fresh.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi"))
            done += [asked, centres, of_key, of_centre, poor, pairs, found, fresh]
        other = few.select("key", *[F.col(c).alias(f"{c}2") for c in ("x", "n", "d", "pos", "s", "c")])
        fits = F.expr(f"x < x2 and c <> c2 and 100 * least(n, n2) >= {percent} * greatest(n, n2) and {whole} * least(d - pos, d2 - pos2) >= s + s2 - t")
        candidates.append(ws.table(few.join(other, "key").where(fits).select("x", F.col("x2").alias("y")).distinct()))
        ws.drop(*done)
        if rows is None:
            break
        labels = ws.table(_near_labels(_all(links)))
        turn += 1

    pairs = _all(candidates).distinct()
    if labels is not None:
        for end in ("x", "y"):
            pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("c").alias(f"c{end}")), end, "left")
        pairs = pairs.where("coalesce(cx, x) <> coalesce(cy, y)").select("x", "y")
    if texts is not None:
        ws.drop(texts)
    pairs = ws.table(pairs)
    pairs = _all(_in_lots(ws, pairs, ["x", "y"], max(1, -(-pairs.count() // max(LOT, n_docs))), lambda lot: _within_reach(lot, marks, percent)))
    ids = ws.table(pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")).distinct())
    packed = ws.table(_packed(docs, ids))
    left, right = packed.select(F.col("doc_id").alias("x"), F.col("packed").alias("p")), packed.select(F.col("doc_id").alias("y"), F.col("packed").alias("q"))
    compare = lambda lot: lot.join(left, "x").join(right, "y").select("x", "y", "p", "q").mapInArrow(_linked(k, percent), "x long, y long").distinct()
    total = pairs.agg(F.sum(F.col("n") + F.col("n2"))).first()[0] or 0
    links += _in_lots(ws, pairs.select("x", "y"), ["x", "y"], max(1, -(-total // max(SHINGLES, n_shingles // 2))), compare)
    ws.drop(packed)

    labels = connected_components(ws, _all(links), "x", "y").select(F.col("id").alias("node"), F.col("component").alias("c"))
    ends = nodes.select("n", "f1", "f2", "node").join(labels, "node", "left").withColumn("c", F.coalesce("c", "node"))
    linked = known.select("doc_id", "n", "f1", "f2").join(ends.select("n", "f1", "f2", "c"), ["n", "f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))
    alone = marks.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: that whose doc_id is the component's; one row of it.

    Rows with a null doc_id stay. Of rows that repeat a doc_id, whatever their texts, one stays, the
    one with the smallest text.
    """
    comps = jaccard_components(docs, k, percent)
    keep = comps.where("doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct()
    kept = docs.join(keep, docs["doc_id"] == keep["_keep"], "left_semi")
    rest = [c for c in docs.columns if c != "doc_id"]
    once = kept.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.coalesce("text", F.lit(""))).alias("_row")).select("doc_id", *[F.col("_row")[c].alias(c) for c in rest])
    return once.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, k=4, percent=85)
