"""N-gram Jaccard join by prefixes of token combinations.

A document is the set of its distinct word shingles; equal sets are one node.
Two sets of which the larger has n shingles and that reach the threshold lack at
most n - o of each other's, o being the least overlap with any partner.  So a
node with more shingles of its own than that has no partner, and everything
after rests on this:

1. Own shingles are counted on a part of the hash range (``SHARE``), block by
   block: a block settles what its own documents share, and sends on one row
   for each other shingle.  Nodes with too many own shingles go.
2. Of the nodes left, all shingles are counted.  The global order is by number
   of nodes (then by hash), so a prefix of n - o + 1 shingles begins with those
   that no other node has, and only the rest of it is indexed.
3. Rare shingles of a prefix are indexed singly.  A set whose prefix holds
   frequent ones (from ``FREQUENT_FROM`` nodes on) uses a prefix longer by g,
   of which g + 1 are shared, and indexes those in combinations of two: dealt
   to g groups by hash, g + 1 shared frequent shingles put two into one group.
   The class of a shingle steers cost only; any classes give the same links.
4. Posting lists of up to ``SMALL`` nodes are verified pair by pair, where set
   sizes and own shingles allow the overlap.  A longer list is never paired
   off: its members are compared with a centre, the shingles that most of them
   have.  Let d(x) be the symmetric difference of x and the centre.  If x and y
   are similar, then either |d(x)| + |d(y)| is so small that this proves it
   (such members are all linked to the nearest one, and are no longer compared
   with each other), or d(x) and d(y) share an element within their first
   D(x) + 1 and D(y) + 1 ones, where D(x) bounds the symmetric difference of x
   and any partner.  So the members are indexed anew by those elements, of
   which no one is common to most of them, until no list is long.

Connected components of the links are the classes.

Defined cases: null and empty texts have no shingle and link with nothing; a
text of fewer than k words is one shingle; very long texts are read whole;
equal texts (and repeated rows) are in one class; rows without an id are left
out of the classes and get a null component_id; an empty table gives an empty
result; other columns, whatever their names, are ignored or, where documents
are returned, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm import shared, tokens

#: Longest posting list that is verified pair by pair.
SMALL = 64
#: Members from which a group's centre is taken.
SAMPLE = 25
#: Nodes from which a shingle is frequent.
FREQUENT_FROM = 64
#: Part of the hash range on which own shingles are first counted, for each part of a set that a partner may lack.
SHARE = 2.5
#: Shingles of that part which a task counts together, and nodes whose sets it remembers having given.
BLOCK, SEEN = 1 << 20, 1 << 16
#: Bits of a shingle's hash.
BITS = 53
#: Bits of the filter in front of the shuffle of sets, and of that of documents that may go.
FILTER_BITS, DOCUMENT_BITS = 26, 23
U64 = np.uint64


class Shingles:
    """The distinct shingles of each row of a slice, ordered by row and hash."""

    def __init__(self, column: pa.Array, k: int):
        data, offsets = tokens.buffers(column)
        start, end, row = tokens.word_spans(data, offsets)
        words = tokens.word_hashes(data, start, end, lower=True)
        rows = len(column)
        at = tokens.ngram_rows(row, k)
        hashes, of = [tokens.ngram_hashes(words, k)[at]], [row[at]]
        count = np.bincount(row, minlength=rows)
        for short in range(1, k):  # the whole sequence as one
            at = tokens.ngram_rows(row, short)
            at = at[count[row[at]] == short]
            hashes.append(tokens.ngram_hashes(words, short)[at])
            of.append(row[at])
        hashes, of = np.concatenate(hashes) >> U64(64 - BITS), np.concatenate(of)
        code = of.astype(U64) << U64(BITS) | hashes  # sorting one word sorts by both
        code.sort()
        code = code[np.r_[True, code[1:] != code[:-1]]] if len(code) else code
        self.hash = code & U64((1 << BITS) - 1)
        self.row = (code >> U64(BITS)).astype(np.int64)
        self.start = np.searchsorted(self.row, np.arange(rows + 1))
        self.n = np.diff(self.start)
        # sums over well-mixed hashes do not depend on the order
        total = [np.append(U64(0), np.cumsum(tokens.mix(self.hash + U64(c)))) for c in (0x51ED27, 0xA0761D)]
        self.a, self.b = (t[self.start[1:]] - t[self.start[:-1]] for t in total)


def least_overlap(n, percent: int):
    """Shared shingles of a set of n with any partner, at least (numbers, arrays or columns)."""
    return F.ceil((n * percent) / 100) if isinstance(n, Column) else -(-percent * n // 100)


def levels(n: int, percent: int) -> int:
    """Logarithm of the number of groups for combinations, by set size."""
    overlap = least_overlap(n, percent)
    return max(1, min(n - overlap + 1, overlap - 1)).bit_length() - 1


def combinations(hashes: np.ndarray, level: int) -> np.ndarray:
    """Keys of the pairs of frequent shingles that fall into one of 2**level groups."""
    out = []
    group = hashes >> U64(BITS - level) if level else np.zeros(len(hashes), U64)
    order = np.lexsort((hashes, group))
    hashes, group = hashes[order], group[order]
    bounds = np.append(np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)) if len(group) else np.zeros(1, int)
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        i, j = np.triu_indices(high - low, 1)
        out.append(tokens.mix(hashes[low + i] * U64(0x9E3779B97F4A7C15) + tokens.mix(hashes[low + j] + U64(level + 1))))
    return np.concatenate(out) if out else np.zeros(0, U64)


def signature(own: np.ndarray, n: int, rare: int, percent: int) -> np.ndarray:
    """Keys of a set of n shingles: own are those that others have, too, in the global order, the first ``rare`` of them not frequent."""
    prefix = n - least_overlap(n, percent) + 1 - (n - len(own))  # what no other has comes first
    if prefix <= rare:
        return own[: max(prefix, 0)]
    top, lower = levels(n, percent), levels(int(least_overlap(n, percent)), percent)  # lower: of the smallest partner
    got = [own[: min(rare, prefix + (1 << top))]]
    got += [combinations(own[rare : prefix + (1 << level)], level) for level in {top, min(top, lower)}]
    return np.concatenate(got)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U64 else x.astype(np.int64))


def _lists(values: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) for x in values)]).astype(np.int32)), _long(np.concatenate([np.zeros(0, values[0].dtype if values else U64), *values])))


def _counted(percent: int) -> int:
    """Hashes below this are counted first."""
    return int((1 << BITS) * min(1.0, SHARE * (100 - percent) / 100))


def members(documents: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, m, a, b: set size, shingles in the part that is counted first, and node of each document."""
    bound = U64(_counted(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.row_slices(batches):
            s = Shingles(batch.column("text"), k)
            m = np.bincount(s.row[s.hash < bound], minlength=len(s.n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s.n.astype(np.int32)), pa.array(m.astype(np.int32)), _long(s.a), _long(s.b)], names=["doc_id", "n", "m", "a", "b"])

    return shared.texts(documents).mapInArrow(run, "doc_id long, n int, m int, a long, b long")


def not_own(documents: DataFrame, k: int, percent: int) -> DataFrame:
    """a, shared: of the shingles that are counted first, about how many (never fewer than) other nodes have, too.

    A block of documents gives a row (shingle, node) for what one of its nodes
    has, a row (shingle, 0) for what several have, and for each node how many
    of the latter it has.  So a shingle has a row a block at most.
    """
    bound = U64(_counted(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def report() -> pa.RecordBatch:
            h, a = (np.concatenate([np.zeros(0, U64), *x]) for x in (zip(*held, strict=True) if held else ((), ())))
            order = np.lexsort((a, h))
            h, a = h[order], a[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (a[1:] != a[:-1])][: len(h)]  # copies count once
            h, a = h[new], a[new]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
            times = np.diff(np.append(first, len(h)))
            single, several = first[times == 1], first[times > 1]
            node, count = np.unique(a[np.repeat(times > 1, times)], return_counts=True)
            zero = np.zeros(len(several), U64)
            columns = (np.concatenate([h[single], h[several], tokens.mix(node) | U64(1 << 63)]), np.concatenate([a[single], zero, node]), np.concatenate([np.zeros(len(single)), np.ones(len(several)), 1 + count]))
            return pa.RecordBatch.from_arrays([_long(columns[0]), _long(columns[1]), pa.array(columns[2].astype(np.int32))], names=["h", "a", "c"])

        for batch in tokens.row_slices(batches):
            s = Shingles(batch.column("text"), k)
            use = s.hash < bound
            held.append((s.hash[use], s.a[s.row[use]]))
            size += len(held[-1][0])
            if size >= BLOCK:
                yield report()
                held, size = [], 0
        yield report()

    rows = shared.texts(documents).mapInArrow(run, "h long, a long, c int")
    same = Window.partitionBy("h")
    rows = rows.select("a", "c", F.min("a").over(same).alias("_low"), F.max("a").over(same).alias("_high")).where("c > 1 OR c = 0 AND _low <> _high")
    return rows.groupBy("a").agg(F.sum(F.when(F.col("c") > 1, F.col("c") - 1).otherwise(1)).alias("shared"))


def sets(documents: DataFrame, k: int, wanted_nodes: DataFrame) -> DataFrame:
    """a, b, n, shingles of the wanted nodes (a, b): what a bitmap lets through is dealt by node."""
    wanted = shared.bitmap(wanted_nodes.select("a"), FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in tokens.row_slices(batches):
            s = Shingles(batch.column("text"), k)
            use = []
            for r in np.flatnonzero(shared.in_bitmap(wanted, s.a) & (s.n > 0)).tolist():
                node = int(s.a[r]), int(s.b[r])
                if node not in seen:  # fewer copies are dealt; which are left out changes nothing
                    seen.add(node)
                    use.append(r)
            if len(seen) > SEEN:
                seen.clear()
            if use:
                yield pa.RecordBatch.from_arrays([_long(s.a[use]), _long(s.b[use]), pa.array(s.n[use].astype(np.int32)), _lists([s.hash[s.start[r] : s.start[r + 1]] for r in use])], names=["a", "b", "n", "shingles"])

    found = shared.texts(documents).mapInArrow(run, "a long, b long, n int, shingles array<long>")
    return found.join(wanted_nodes.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b", "n").agg(F.first("shingles").alias("shingles"))


def ordered(held: DataFrame, percent: int) -> DataFrame:
    """a, b, n, own, rare, most: shingles that other nodes have, in the global order, how many of them are not frequent, and the largest set that may be a partner."""
    rows = held.select("a", "b", "n", F.explode("shingles").alias("h"))
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    lists = rows.join(counts, "h").groupBy("a", "b", "n").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("l"))
    found = lists.select("a", "b", "n", F.col("l.h").alias("own"), F.size(F.filter("l", lambda x: x["c"] < FREQUENT_FROM)).alias("rare"))
    n, both = F.col("n"), F.size("own")
    found = found.withColumn("most", F.floor(both * (100 + percent) / percent).cast("int") - n)
    return found.where(F.col("most") >= least_overlap(n, percent))


def index(nodes: DataFrame, percent: int) -> DataFrame:
    """key, a, b, n, most: each node's postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [signature(np.array(own, np.int64).view(U64), n, rare, percent) for own, n, rare in zip(*(batch.column(c).to_pylist() for c in ("own", "n", "rare")), strict=True)]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in keys]))
            yield pa.RecordBatch.from_arrays([_long(np.concatenate([np.zeros(0, U64), *keys])), *(batch.column(c).take(rows) for c in ("a", "b", "n", "most"))], names=["key", "a", "b", "n", "most"])

    return nodes.mapInArrow(run, "key long, a long, b long, n int, most int")


def _pairs(lists: DataFrame, percent: int) -> DataFrame:
    """xa, xb, ya, yb: the pairs within each list ``l`` (ordered by set size), once, that sizes and own shingles allow."""
    partner = f"y.n * {percent} <= x.n * 100 AND y.n <= x.most AND x.n <= y.most AND (x.label IS NULL OR y.label IS NULL OR x.label <> y.label)"
    pairs = lists.select(F.posexplode("l").alias("i", "x"), "l").select("x", F.explode(F.expr(f"filter(slice(l, i + 2, size(l)), y -> {partner})")).alias("y"))
    x, y = (F.struct(F.col(f"{s}.a"), F.col(f"{s}.b")) for s in "xy")
    pairs = pairs.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    return pairs.select(F.col("x.a").alias("xa"), F.col("x.b").alias("xb"), F.col("y.a").alias("ya"), F.col("y.b").alias("yb")).distinct()


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those pairs xa, xb, ya, yb that are similar."""
    for s in "xy":
        pairs = pairs.join(nodes.select(F.col("a").alias(f"{s}a"), F.col("b").alias(f"{s}b"), F.col("n").alias(f"{s}n"), F.col("own").alias(f"{s}s")), [f"{s}a", f"{s}b"])
    both = F.size(F.array_intersect("xs", "ys"))
    return pairs.where(100 * both >= percent * (F.col("xn") + F.col("yn") - both)).select("xa", "xb", "ya", "yb")


def centres(groups: DataFrame, nodes: DataFrame, step: int) -> DataFrame:
    """g, centre: the shingles that most of a group's sample of up to ``SAMPLE`` members have."""
    part = F.pmod(F.xxhash64("a", "b", "g", F.lit(step)), F.lit(SAMPLE))
    sample = groups.groupBy("g", part.alias("_part")).agg(F.min(F.struct("a", "b")).alias("_s")).select("g", F.col("_s.a").alias("a"), F.col("_s.b").alias("b"))
    sample = sample.join(nodes.select("a", "b", "own"), ["a", "b"]).groupBy("g").agg(F.collect_list("own").alias("sample"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column("sample").to_pylist():
                value, count = np.unique(np.concatenate([np.array(x, np.int64) for x in own]), return_counts=True)
                out.append(value[2 * count > len(own)])
            yield pa.RecordBatch.from_arrays([batch.column("g"), _lists(out)], names=["g", "centre"])

    return sample.mapInArrow(run, "g long, centre array<long>")


def differences(groups: DataFrame, nodes: DataFrame, percent: int, step: int) -> DataFrame:
    """g, a, b, n, most, label, excess, keys: each member's difference from its group's centre.

    Two members are similar for sure if their excesses add up to 0 or less:
    then both differences together are no more than the threshold allows.
    """
    rows = groups.join(nodes.select("a", "b", "own"), ["a", "b"]).join(centres(groups, nodes, step), "g")
    alone = F.col("n") - F.size("own")
    elements = F.concat(F.array_except("own", "centre"), F.transform(F.array_except("centre", "own"), lambda x: -1 - x))
    rows = rows.select("g", "a", "b", "n", "most", "label", alone.alias("_alone"), elements.alias("_elements"))
    excess = (100 + percent) * (F.col("_alone") + F.size("_elements")) - (100 - percent) * F.col("n")
    first = F.floor(F.col("n") * (100 - percent) / percent).cast("int") + 1 - F.col("_alone")
    keys = F.transform(F.slice("_elements", 1, F.greatest(first, F.lit(0))), lambda x: F.xxhash64("g", x))
    return rows.select("g", "a", "b", "n", "most", "label", excess.alias("excess"), keys.alias("keys"))


def links(postings: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Enough links xa, xb, ya, yb that their components are those of all links.

    Members that have one label are linked already.
    """
    found, step = [], 0
    postings = postings.withColumn("label", F.lit(None).cast("long"))
    while True:
        stats = postings.groupBy("key").agg(F.count(F.lit(1)).alias("_size"), F.min("n").alias("_least"), F.max("most").alias("_most"), F.count("label").alias("_labels"), F.min("label").alias("_one"), F.max("label").alias("_other"))
        stats = stats.where("_size > 1 AND NOT (_labels = _size AND _one = _other)").select("key", "_size", "_least", "_most")
        sized = shared.cut(postings.join(stats, "key").where("most >= _least AND n <= _most"))
        lists = sized.where(F.col("_size") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "a", "b", "most", "label"))).alias("l"))
        pairs = shared.cut(_pairs(lists.select("l").distinct(), percent))
        found.append(shared.cut(verified(pairs, nodes, percent)))
        rest = sized.where(F.col("_size") > SMALL)
        if rest.isEmpty():
            break
        if step == 0:  # lists of one family of copies have the same heaviest member: they are one group
            weight = rest.groupBy("a", "b").agg(F.sum("_size").alias("_weight"))
            heaviest = rest.join(weight, ["a", "b"]).groupBy("key").agg(F.max(F.struct("_weight", "a", "b")).alias("_p"))
            names = heaviest.select("key", F.xxhash64("_p.a", F.lit(step)).alias("g"))
        else:  # equal lists only, so that a group is a part of the one that it comes from
            names = rest.groupBy("key").agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("_sum"), F.count(F.lit(1)).alias("_n")).select("key", F.xxhash64("_sum", "_n", F.lit(step)).alias("g"))
        groups = shared.cut(rest.join(names, "key").groupBy("g", "a", "b", "n", "most").agg(F.min("label").alias("label")))
        rows = shared.cut(differences(groups, nodes, percent, step))
        nearest = rows.groupBy("g").agg(F.min(F.struct("excess", "a", "b")).alias("_z"))
        rows = rows.join(nearest, "g").withColumn("_near", F.col("excess") + F.col("_z.excess") <= 0)
        found.append(rows.where("_near AND (a <> _z.a OR b <> _z.b)").select(F.col("a").alias("xa"), F.col("b").alias("xb"), F.col("_z.a").alias("ya"), F.col("_z.b").alias("yb")))
        label = F.when(F.col("_near"), F.xxhash64("g", F.lit(step))).otherwise(F.col("label"))
        postings = rows.select(F.explode("keys").alias("key"), "a", "b", "n", "most", label.alias("label"))
        step += 1
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def classes(documents: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links of at least ``percent`` % similarity.

    percent is 60 or more.
    """
    if percent < 60:
        raise ValueError("percent must be 60 or more")
    shared.prepare(documents.sparkSession)
    rows = shared.cut(members(documents, k, percent))
    nodes = shared.cut(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.min("n").alias("n"), F.min("m").alias("m")))
    own = documents.where("doc_id IS NOT NULL")
    lack = F.col("n") - least_overlap(F.col("n"), percent)
    counted = nodes.join(not_own(own, k, percent), "a", "left")
    alive = counted.where((F.col("m") - F.coalesce("shared", F.lit(0)) <= lack) & (F.floor(F.col("n") * 100 / percent) > F.col("n")))
    held = shared.cut(sets(own, k, shared.cut(alive.select("a", "b"))))
    indexed = shared.cut(ordered(held, percent))
    found = links(index(indexed, percent), indexed, percent)
    ends = [nodes.select(F.col("a").alias(f"{s}a"), F.col("b").alias(f"{s}b"), F.col("first").alias(t)) for s, t in (("x", "u"), ("y", "v"))]
    edges = found.join(ends[0], ["xa", "xb"]).join(ends[1], ["ya", "yb"]).select("u", "v")
    merged = shared.components(edges).withColumnRenamed("node", "first")
    named = nodes.join(merged, "first", "left").select("a", "b", F.coalesce("component", "first").alias("component_id"))
    out = rows.join(named, ["a", "b"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, unchanged and with all their columns, that are the smallest id of their class.

    Of repeated rows of one id one stays; rows without an id all stay.  Only
    documents that may go are dealt by id.
    """
    found = shared.cut(classes(documents, k, percent))
    gone = shared.cut(found.where("component_id <> doc_id").select("doc_id").union(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")).distinct())
    doubtful = shared.bitmap(gone, DOCUMENT_BITS)

    def part(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = batch.column("doc_id")
                may_go = shared.in_bitmap(doubtful, key.fill_null(0).to_numpy().astype(np.int64).view(U64)) & key.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(may_go == wanted))

        return documents.mapInArrow(run, documents.schema)

    others = found.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    dealt = part(True)
    dealt = dealt.join(others, dealt["doc_id"] == others["__gone"], "left_anti").dropDuplicates(["doc_id"])
    return part(False).union(dealt)
