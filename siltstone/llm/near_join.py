"""Jaccard self-join on word n-grams by a MinHash LSH forest (operator 8).

Texts that are equal stand for each other. Each distinct text gets a signature,
a string of values for each tree of the forest. A tree is a prefix trie, held as
the sorted strings: texts that share a prefix lie under one of its nodes, and the
nodes of a depth are the runs of strings that agree so far.

Strings are sorted in ranges, tree by tree, and each takes the longest prefix that
it shares with a neighbour there: no other text shares a longer one with it. A text
leaves a tree at the level at which it has company no more, so only texts with
matched prefixes are shortened further.

How far they are shortened is found from the data. The links of a bounded sample
of texts to all others are determined exactly, together with the longest prefix
that each linked pair shares in any tree. Starting from whole strings, the prefix
loses a value until the share of links that meet under some node, as measured and
as expected from the links' similarities, reaches the target recall. Once all
links of that level are verified, their similarities say how many more there must
be that did not meet; if that leaves the recall below the target, prefixes lose
one more value. The recall so measured is returned with the result.

Nodes of that depth with more than one text are the candidate groups; a node
whose texts all lie under a larger one is left out. Pairs are verified exactly,
on the words themselves, under the nodes they share, and each pair once: under
the first of these. A group that is too large for a task is first held against
one of its texts, the pivot. Texts so near to it that they must be linked to
each other (Jaccard distance is a metric) are counted, not compared; the others
are compared in blocks, each task bounded. Tasks give a count of links for each
text and a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm import arrays
from siltstone.llm.columns import map_arrow, quoted, unused
from siltstone.llm.components import connected_components
from siltstone.llm.naming import row_key
from siltstone.llm.scratch import Scratch

SLICE_BYTES = 1 << 20
TREES, DEPTH = 24, 8
SIMILARITY, NGRAM, TARGET_RECALL = 0.8, 5, 0.9999
#: A block of a group has this much text or so many texts at most, about; so has, twice, a verifying task.
BLOCK_BYTES, BLOCK_TEXTS = 2 << 20, 512
#: The sample by which prefixes are shortened: so many distinct texts of at most so many bytes.
SAMPLE_TEXTS, SAMPLE_BYTES = 1024, 1 << 15
#: So many links at the limit are counted in with those of the sample.
LIMIT_LINKS, MARGIN = 10, 4
#: A range of sorted strings has about so many.
RANGE_STRINGS = 1 << 20


def meeting(similarity: np.ndarray | float, depth: int, trees: int) -> np.ndarray | float:
    """The probability that two texts share a prefix of ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def _shingles(w: arrays.Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each n-gram and its row; a row of fewer words is one n-gram of all its words."""
    starts = arrays.whole_windows(w.row, n)
    grams, row = arrays.window_hashes(hashes, n)[starts], w.row[starts]
    counts = np.diff(w.rows)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        begin = w.rows[short]
        whole = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            more = counts[short] > k
            whole[more] = arrays.mix64(whole[more] ^ hashes[begin[more] + k])
        grams, row = np.concatenate([grams, whole]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        grams, row = grams[order], row[order]
    return grams, row


def _signature(grams: np.ndarray, row: np.ndarray, n: int, trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings of 16-bit values (rows by trees by depth), and which rows have any word."""
    filled = np.unique(row)
    first = np.searchsorted(row, filled)
    values = np.zeros((n, trees, depth), ">u2")
    if len(filled):
        short = (grams >> np.uint64(32)).astype(np.uint32)
        seeds = arrays.mix64(np.arange(2 * trees * depth, dtype=np.uint64)).reshape(2, trees, depth)
        for t in range(trees):
            for d in range(depth):
                flip, odd = np.uint32(seeds[0, t, d] >> np.uint64(32)), np.uint32(seeds[1, t, d] & np.uint64(0xFFFFFFFF)) | np.uint32(1)
                values[filled, t, d] = arrays.mix64(np.minimum.reduceat((short ^ flip) * odd, first)) & np.uint64(0xFFFF)
    have = np.zeros(n, bool)
    have[filled] = True
    return values, have


class _Sample(NamedTuple):
    """The n-grams of sampled texts: sorted distinct hashes, the texts of each, and their strings."""

    grams: np.ndarray
    bounds: np.ndarray  # of each distinct hash in texts
    texts: np.ndarray
    sizes: np.ndarray  # distinct n-grams of each text
    values: np.ndarray


def _once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of two arrays, in order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _sample(texts: list[str], ngram: int, trees: int, depth: int) -> _Sample:
    w = arrays.words(*arrays.utf8(pa.array(texts, pa.string())))
    number, distinct = arrays.numbered(w.data, w.bounds)
    grams, row = _shingles(w, arrays.word_hashes(distinct)[number], ngram)
    values, _ = _signature(grams, row, len(texts), trees, depth)
    grams, row = _once(grams, row)
    known, first = np.unique(grams, return_index=True)
    return _Sample(known, np.append(first, len(grams)), row, np.bincount(row, minlength=len(texts)), values)


def _links_to(sample: _Sample, grams: np.ndarray, row: np.ndarray, values: np.ndarray, similarity: float, trees: int) -> np.ndarray:
    """For each row ``(2, depth + 1)`` sums over its links to sampled texts.

    First how many share so many values in some tree at most, then how likely
    links of such similarities are to share at least so many.
    """
    n, depth = values.shape[0], values.shape[2]
    out = np.zeros((n, 2, depth + 1))
    if not len(sample.grams) or not len(grams):
        return out
    at = np.minimum(np.searchsorted(sample.grams, grams), len(sample.grams) - 1)
    touched = np.zeros(n, bool)
    touched[row[sample.grams[at] == grams]] = True
    mine = touched[row]
    row, grams = _once(row[mine], grams[mine])
    size = np.bincount(row, minlength=n)
    at = np.minimum(np.searchsorted(sample.grams, grams), len(sample.grams) - 1)
    known = sample.grams[at] == grams
    owner, at = row[known], at[known]
    times = sample.bounds[at + 1] - sample.bounds[at]
    met = arrays.take_ragged(sample.texts, sample.bounds[at], times)
    both, common = np.unique(np.repeat(owner, times).astype(np.int64) * len(sample.sizes) + met, return_counts=True)
    a, b = both // len(sample.sizes), both % len(sample.sizes)
    union = size[a] + sample.sizes[b] - common
    near = common * 1_000_000 >= round(similarity * 1_000_000) * union
    a, b, close = a[near], b[near], (common / union)[near]
    agree = np.minimum.accumulate(values[a] == sample.values[b], axis=2).sum(2).max(1, initial=0)
    other = (values[a] != sample.values[b]).any((1, 2)) | (close < 1)  # not the sampled text itself
    a, close, agree = a[other], close[other], agree[other]
    np.add.at(out, (a, 0, agree), 1)
    for d in range(depth + 1):
        np.add.at(out, (a, 1, d), meeting(close, d, trees))
    return out


def shortened(found: np.ndarray, similarity: float, trees: int, recall: float) -> tuple[int, float]:
    """The longest prefix that reaches ``recall``, and the recall measured with it.

    ``found`` are the sums of ``_links_to`` over all texts. LIMIT_LINKS links at
    the limit of ``similarity`` are added, so that where there are few links the
    limit decides. A prefix that reaches ``recall`` for links at the limit reaches it
    for all; a longer one has to be expected to lose no more than a MARGIN-th of
    what may be lost, for to verify a second level costs more than a shorter prefix.
    """
    depth = found.shape[1] - 1
    if meeting(similarity, 1, trees) < recall:
        raise ValueError(f"{trees} trees don't reach a recall of {recall} at similarity {similarity}, whatever the prefix")
    links = found[0].sum()
    for d in range(depth, 0, -1):
        measured = found[0, d:].sum() / links if links else 1.0
        expected = (LIMIT_LINKS * meeting(similarity, d, trees) + found[1, d]) / (LIMIT_LINKS + links)
        if meeting(similarity, d, trees) >= recall or min(measured, 1 - MARGIN * (1 - expected)) >= recall:
            break
    return d, float(measured)


def shared_prefixes(tree: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each two neighbours of sorted strings how many values they share at the front; none across trees."""
    same = np.minimum.accumulate(values[1:] == values[:-1], axis=1).sum(1)
    return np.where(tree[1:] == tree[:-1], same, 0)


def _matched(texts: DataFrame, trees: int, depth: int) -> DataFrame:
    """``node, key`` of the texts that share a prefix of ``depth`` values in a tree with a neighbour in its sorted strings.

    Ranges are sorted by themselves, so a range's first and last string are kept
    whatever they share: at most two strings of each range too many.
    """
    cut = lambda t: F.struct(F.lit(t).alias("tree"), F.substring("strings", 2 * DEPTH * t + 1, 2 * DEPTH).alias("string"))
    leaves = texts.where("have").select("node", F.explode(F.array(*[cut(t) for t in range(trees)])).alias("leaf")).select("leaf.tree", "leaf.string", "node")
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-texts.count() * trees // RANGE_STRINGS))
    ranged = leaves.repartitionByRange(parts, "tree", "string", "node").sortWithinPartitions("tree", "string", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, DEPTH
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            shared = shared_prefixes(whole.column(0).to_numpy(), arrays.utf8(whole.column(1))[0].view(np.uint16).reshape(whole.num_rows, DEPTH))
            # The last row waits for the batch after this one.
            reach = np.maximum(np.concatenate([[before], shared[:-1]]), shared) if len(shared) else np.zeros(0, np.int64)
            kept = np.flatnonzero(reach >= depth)
            yield whole.take(pa.array(kept))
            held, before = whole.slice(whole.num_rows - 1), int(shared[-1]) if len(shared) else before
        if held is not None:
            yield held

    matched = map_arrow(ranged, run, "tree int, string binary, node bigint")
    return matched.select("node", F.xxhash64("tree", F.substring("string", 1, 2 * depth)).alias("key"))


def _gram_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact n-gram numbers of each text, sorted by text, with bounds; no hash decides equality."""
    w = arrays.words(*arrays.utf8(pa.array(texts, pa.string())))
    number, _ = arrays.numbered(w.data, w.bounds)
    number = number.astype(np.int64) + 1
    starts = arrays.whole_windows(w.row, n)
    counts = np.diff(w.rows)
    short = np.flatnonzero((counts > 0) & (counts < n))
    grams = np.zeros((len(starts) + len(short), n), np.int64)
    for k in range(n):
        grams[: len(starts), k] = number[starts + k]
    for k in range(n - 1):
        more = counts[short] > k
        grams[len(starts) :, k][more] = number[w.rows[short][more] + k]
    row = np.concatenate([w.row[starts], short])
    # Name the n-grams by naming pairs of (name so far, next word): sorting integers only.
    name = grams[:, 0]
    for k in range(1, n):
        _, name = np.unique(name * (len(number) + 2) + grams[:, k], return_inverse=True)
    pairs = np.unique(row.astype(np.int64) * (int(name.max()) + 1 if len(name) else 1) + name)
    width = int(name.max()) + 1 if len(name) else 1
    row, name = pairs // width, pairs % width
    return row, name, np.bincount(row, minlength=len(texts))


class _Shared:
    """Counts of common n-grams, a bounded dense block of the n-gram table at a time."""

    def __init__(self, row: np.ndarray, name: np.ndarray, n: int, cells: int = 2 << 20):
        _, name, df = np.unique(name, return_inverse=True, return_counts=True)
        often = df[name] > 1
        used, column = np.unique(name[often], return_inverse=True)
        order = np.argsort(column, kind="stable")
        self.n, self.row, self.column, self.width = n, row[often][order], column[order], len(used)
        self.rows, self.step = max(16, cells // max(n, 1)), max(64, cells // max(n, 1))

    def between(self, a: int, b: int, c: int) -> np.ndarray:
        """Texts a..b against all from c on."""
        out = np.zeros((b - a, self.n - c), np.float32)
        for at in range(0, self.width, self.step):
            i, j = np.searchsorted(self.column, [at, at + self.step])
            block = np.zeros((self.n, min(self.step, self.width - at)), np.float32)
            block[self.row[i:j], self.column[i:j] - at] = 1
            out += block[a:b] @ block[c:].T
        return out


def _compare(group: pd.DataFrame, n: int, similarity: float, depth: int, trees: int) -> pd.DataFrame:
    """Links of the pairs that a task has to verify: counts, and a forest of them.

    ``i`` and ``j`` are the blocks: all pairs of one, or of one with the other.
    A pair that shares one of the groups ``before`` this one is left to that.
    ``pairs`` counts the links of a text that were found here, each at one of its
    ends, and ``weight`` those that there are to be expected, met or not, by how
    likely links of their similarities meet.
    """
    group = group.drop_duplicates("node").sort_values("node", ignore_index=True)
    i, j, split = int(group["i"].iloc[0]), int(group["j"].iloc[0]), len(group)
    if i != j:  # block i first, then block j
        first = group["block"] == i
        split = int(first.sum())
        group = pd.concat([group[first], group[~first]], ignore_index=True)
    row, name, size = _gram_sets(group["text"].tolist(), n)
    shared = _Shared(row, name, len(group))
    sizes = group["before"].map(len).to_numpy()
    earlier = _Shared(np.repeat(np.arange(len(group)), sizes), np.concatenate([np.zeros(0, np.int64), *group["before"]]), len(group))
    node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
    links, root = np.zeros(len(group), np.int64), np.arange(len(group))
    pairs, weight = np.zeros(len(group), np.int64), np.zeros(len(group))
    # Whole numbers decide, so that a pair at the limit isn't lost to rounding.
    limit = round(similarity * 1_000_000)
    for a in range(0, split, shared.rows):
        b = min(a + shared.rows, split)
        c = a if i == j else split  # every pair once
        common = shared.between(a, b, c)
        near = np.empty(common.shape, bool)
        for x, row_common in enumerate(common):  # of the union: both sets less what they share
            near[x] = row_common.astype(float) * (1_000_000 + limit) >= limit * (size[a + x] + size[c:])
            if i == j:
                near[x, : x + 1] = False
        if earlier.width:
            near &= earlier.between(a, b, c) == 0
        links[a:b] += near @ copies[c:]
        links[c:] += copies[a:b] @ near
        for x in np.flatnonzero(near.any(1)).tolist():
            alike = common[x][near[x]].astype(float)
            alike = alike / (size[a + x] + size[c:][near[x]] - alike)
            pairs[a + x], weight[a + x] = pairs[a + x] + len(alike), weight[a + x] + (1 / meeting(alike, depth, trees)).sum()
            met = np.unique(np.append(root[c:][near[x]], root[a + x]))
            if len(met) > 1:
                root[np.isin(root, met[1:])] = met[0]
    least = np.full(len(group), np.iinfo(np.int64).max)
    np.minimum.at(least, root, node)
    out = pd.DataFrame({"node": node, "links": links, "root": least[root], "pairs": pairs, "weight": weight})
    del shared, earlier, row, name
    arrays.release()
    return out


def _beside_pivot(group: pd.DataFrame, n: int, similarity: float) -> pd.DataFrame:
    """How near each text of a block is to the pivot: ``core``, ``far`` from all the core, or neither."""
    group = group.drop_duplicates("node").sort_values("is_pivot", ascending=False, ignore_index=True)
    row, name, size = _gram_sets(group["text"].tolist(), n)
    pivot = name[row == 0]
    common = np.bincount(row[np.isin(name, pivot)], minlength=len(group))
    union = size + size[0] - common
    limit = round(similarity * 1_000_000)
    # A distance of half the limit's from the pivot each: no more than the limit's between two.
    core = (common * 2_000_000 >= (1_000_000 + limit) * union) & (group["before"].map(len).to_numpy() == 0)
    far = common * 2_000_000 < (3 * limit - 1_000_000) * union
    mine = (group["block"] == group["task"]).to_numpy()  # the pivot is in a block of its own too
    return pd.DataFrame({"gid": group["gid"], "node": group["node"], "core": core, "far": far})[mine]


def _groups(under: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, gid, before``: the groups of each text, and the groups that come before each of these.

    Of nodes with the same texts one is a group. Groups are ordered from large
    to small; one whose texts all have the same first group, another one, isn't
    needed, for all its pairs meet there.
    """
    pick = lambda salt: F.xxhash64("node", F.lit(salt))
    shared = under.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.sum(pick(1).cast("decimal(38,0)")).alias("s"), F.bit_xor(pick(2)).alias("x")).where("n > 1")
    once = scratch.keep(shared.groupBy("n", "least", "s", "x").agg(F.min("key").alias("gid")).select("gid", (-F.col("n")).alias("less")), "nodes")
    members = under.join(once, under["key"] == once["gid"]).select("node", F.struct("less", "gid").alias("g"))
    # A text has no more groups than there are trees.
    lists = scratch.keep(members.groupBy("node").agg(F.sort_array(F.collect_list("g")).alias("all")), "lists")
    tops = lists.select(F.explode("all").alias("g"), F.col("all")[0].alias("top")).groupBy("g").agg(F.min("top").alias("a"), F.max("top").alias("b"))
    needed = scratch.keep(tops.where("a <> b OR a = g").select(F.col("g.gid").alias("needed")), "needed")
    each = lists.select("node", F.explode("all").alias("g"))
    each = each.join(needed, F.col("g.gid") == F.col("needed")).groupBy("node").agg(F.sort_array(F.collect_list("g")).alias("all"))
    each = each.select("node", F.expr("transform(all, x -> x.gid)").alias("all")).select("node", "all", F.posexplode("all").alias("at", "gid"))
    return scratch.keep(each.select("node", "gid", F.slice("all", F.lit(1), F.col("at")).alias("before")), "members")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, ngram: int = NGRAM, trees: int = TREES, recall: float = TARGET_RECALL, block_bytes: int = BLOCK_BYTES, sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, row_key, class_id, copy_of, n_links, kept, recall``.

    Two texts are linked if the sets of their runs of ``ngram`` words have a
    Jaccard similarity of at least ``similarity``. Words are runs of bytes other
    than white space; a text of fewer words is one run of all its words; a text
    without a word (null, empty) has no links but to texts equal to it. A class
    is what links connect; ``class_id`` is its smallest id, ``copy_of`` the
    smallest id with the very same text, and ``n_links`` counts the other rows
    linked to this one, copies included. One row of each class is ``kept``, the
    one with the smallest id. Rows that share an id are told apart by
    ``row_key``, a hash of the text; of repeated rows all are kept or none. A
    null id is larger than any. An empty table gives an empty one; other columns
    are not read, whatever their names. Equal texts and texts of equal n-grams
    always meet; of all other links at least the share ``recall`` is expected to
    be found. The column ``recall`` says which share was, by the similarities of
    all links that were compared; without any, which share of links at the limit
    would be. The sample of ``sample_texts`` texts decides how far prefixes are
    shortened, never which rows are searched.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), row_key(text_col), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    sample = spark.sparkContext.broadcast(_sample(_sampled(rows, sample_texts), ngram, trees, DEPTH))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "text", SLICE_BYTES):
            w = arrays.words(*arrays.utf8(part.column(3)))
            number, distinct = arrays.numbered(w.data, w.bounds)
            grams, row = _shingles(w, arrays.word_hashes(distinct)[number], ngram)
            values, have = _signature(grams, row, part.num_rows, trees, DEPTH)
            found = _links_to(sample.value, grams, row, values, similarity, trees)
            found = [x.ravel().tolist() if x.any() else None for x in found]
            strings = pa.array([v.tobytes() for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], strings, pa.array(have), pa.array(pc.binary_length(part.column(3)), pa.int64()), pa.array(found, pa.list_(pa.float64()))], names=["id", "row_key", "digest", "strings", "have", "bytes", "found"])

    signed = scratch.keep(map_arrow(rows, sign, "id bigint, row_key bigint, digest binary, strings binary, have boolean, bytes bigint, found array<double>"), "signed")

    # A text's number is given once, as the table is written.
    texts = signed.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("strings", "have", "bytes", "found")])
    texts = scratch.keep(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    found = np.zeros(2 * (DEPTH + 1))
    for r in texts.where("found IS NOT NULL").select(F.posexplode("found").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():
        found[r["at"]] = r["v"]
    depth, _ = shortened(found.reshape(2, -1), similarity, trees, recall)
    while True:
        groups = _groups(scratch.keep(_matched(texts, trees, depth), "under"), scratch)
        checked = scratch.keep(_verified(docs, id_col, text, texts, groups, scratch, ngram, similarity, block_bytes, depth, trees), "checked")
        pairs, weight = checked.agg(F.sum("pairs"), F.sum("weight")).first()
        measured = pairs / weight if pairs else float(meeting(similarity, depth, trees))
        if measured >= recall or depth == 1:
            break
        depth -= 1
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch, "classes")

    names = texts.select("node", "digest", "first", "copies").join(links, "node", "left").join(classes, "node", "left")
    names = scratch.keep(names.select("digest", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("class")), "names")
    least = names.groupBy("class").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "digest")).alias("best"))
    names = names.join(least, "class").select(F.col("digest").alias("d"), "first", "copies", "links", F.col("best.first").alias("class_id"), F.col("best.digest").alias("class_digest"))
    names = scratch.keep(names, "result")
    scratch.drop("texts", "under", "nodes", "lists", "needed", "members", "whole", "placed", "bodies", "beside", "sorted", "cores", "sizes", "checked", "names")
    out = signed.select("id", "row_key", "digest").join(names, F.col("digest") == F.col("d"))
    return out.select(
        F.col("id").alias(id_col),
        "row_key",
        "class_id",
        F.col("first").alias("copy_of"),
        (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("class_digest"))).alias("kept"),
        F.lit(round(measured, 6)).alias("recall"),
    )


def _sampled(rows: DataFrame, most: int) -> list[str]:
    """The ``most`` distinct texts of at most SAMPLE_BYTES bytes whose hashes hash lowest."""
    small = rows.where(F.octet_length("text") <= SAMPLE_BYTES).select(F.xxhash64("text").alias("h"), "text")
    lowest = [r["h"] for r in small.select("h").distinct().orderBy(F.xxhash64("h"), "h").limit(most).collect()]
    return [r["text"] for r in small.where(F.col("h").isin(lowest)).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect()] if lowest else []


def _verified(docs: DataFrame, id_col: str, text: Column, texts: DataFrame, groups: DataFrame, scratch: Scratch, ngram: int, similarity: float, block_bytes: int, depth: int, trees: int) -> DataFrame:
    """``node, links, root, pairs, weight`` of all pairs that share a group; a text may have several rows."""
    sized = groups.join(texts.select("node", "digest", "first", "copies", "bytes"), "node").withColumn("bytes", F.col("bytes") + max(1, block_bytes // BLOCK_TEXTS))
    blocks_of = lambda b: F.ceil(b / F.lit(block_bytes)).cast("int")
    leads = F.min(F.when(F.size("before") == 0, F.col("node"))).alias("pivot")
    # Facts of a group are tables of their own: the join that takes them back to its texts can then be split.
    whole = scratch.keep(sized.groupBy("gid").agg(blocks_of(F.sum("bytes")).alias("blocks"), leads), "whole")
    placed = scratch.keep(sized.join(whole, "gid").withColumn("block", F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))).cast("int")), "placed")
    wanted = placed.groupBy("node").agg(F.first("digest").alias("digest"), F.first("first").alias("first"))
    bodies = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("d"), text.alias("text"))
    bodies = bodies.join(wanted, (F.col("d") == F.col("digest")) & F.col("id").eqNullSafe(F.col("first"))).select("node", "text")
    bodies = scratch.keep(bodies.dropDuplicates(["node"]), "bodies")

    # Large groups: each block beside the pivot.
    large = placed.where("blocks > 1 AND pivot IS NOT NULL").select("gid", "node", "before", "block", "blocks", (F.col("node") == F.col("pivot")).alias("is_pivot"))
    everywhere = F.when(F.col("is_pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    beside = large.withColumn("task", F.explode(everywhere)).join(bodies, "node").select("gid", "node", "before", "block", "task", "is_pivot", "text")
    beside = beside.groupBy("gid", "task").applyInPandas(lambda g: _beside_pivot(g, ngram, similarity), "gid bigint, node bigint, core boolean, far boolean")
    beside = scratch.keep(beside, "beside").select(F.col("gid").alias("g"), F.col("node").alias("v"), "core", "far")
    placed = placed.join(beside, (F.col("gid") == F.col("g")) & (F.col("node") == F.col("v")), "left")
    placed = placed.select("gid", "node", "before", "copies", "bytes", "pivot", F.coalesce("core", F.lit(False)).alias("core"), F.coalesce("far", F.lit(False)).alias("far"))
    placed = scratch.keep(placed, "sorted")

    # All of a core are linked to each other and to the pivot.
    cores = scratch.keep(placed.where("core").groupBy(F.col("gid").alias("g")).agg(F.sum("copies").alias("total")), "cores")
    counted = placed.where("core").join(cores, F.col("gid") == F.col("g")).select("node", (F.col("total") - F.col("copies")).alias("links"), F.col("pivot").alias("root"), F.lit(0).cast("long").alias("pairs"), F.lit(0.0).alias("weight"))

    # The others in blocks against each other, and those not far from it against the core's blocks.
    kind = lambda core: F.sum(F.when(F.col("core") == core, F.col("bytes")).otherwise(0))
    sizes = scratch.keep(placed.groupBy(F.col("gid").alias("g")).agg(blocks_of(kind(False)).alias("loose"), blocks_of(kind(True)).alias("tight")), "sizes")
    placed = placed.join(sizes, F.col("gid") == F.col("g")).where("loose > 0")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("core"), F.col("tight")).otherwise(F.col("loose")))
    placed = placed.withColumn("block", (own + F.when(F.col("core"), F.col("loose")).otherwise(0)).cast("int"))
    last = F.when(F.col("core") | F.col("far") | (F.col("tight") == 0), F.col("loose")).otherwise(F.col("loose") + F.col("tight")) - 1
    tasks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    tasks = tasks.select("gid", "node", "before", "copies", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(bodies, "node")
    compared = tasks.groupBy("gid", "i", "j").applyInPandas(lambda g: _compare(g, ngram, similarity, depth, trees), "node bigint, links bigint, root bigint, pairs bigint, weight double")
    return counted.unionByName(compared)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, all columns as they are.

    ``docs`` should hold no repeated rows; they would all be kept or all go. Null
    and empty texts, ties and empty tables are as in ``near_duplicates``; other
    columns may have any names.
    """
    scratch = Scratch(docs.sparkSession, "near-kept")
    found = near_duplicates(docs, id_col, text_col, **options)
    own_id, own_key = unused(docs, "id", "key")
    gone = scratch.keep(found.where("NOT kept").select(F.col(quoted(id_col)).alias(own_id), F.col("row_key").alias(own_key)).distinct(), "gone")
    return docs.join(gone, F.col(quoted(id_col)).cast("long").eqNullSafe(F.col(own_id)) & (row_key(text_col) == F.col(own_key)), "left_anti")
