"""Near-duplicate groups by a chosen-path set similarity join.

Each of ``TREES`` independent trees branches the documents: at every node a few
minwise tokens are chosen, and a document goes to the child of each chosen
token's value. So documents of high similarity meet in some node with high
probability, and others part after one or two levels. Larger nodes branch on.
A pair with Jaccard similarity s meets in a tree's two levels with probability
(1 - (1 - s)**2)**2, and again the same for two levels more where nodes are
large. At 0.8, five trees miss it with less than one in 300,000 (one in 12,000
in large nodes); at 0.85 with less than one in 5,000,000 (one in 200,000).

Nodes are counted before anything moves, so a node of one member costs a short
row. The members of the others meet once, as numbers with a 128-bit sketch; a
pair stays a candidate unless its sizes exclude the similarity or its sketches
do by more than 5.5 standard deviations. Candidates that hang together form one
group, so each text travels once, to the only place where it is compared, on
full shingle sets, with all of its group. Only groups above the bounds are
compared node by node instead. Nodes that stay large at the last level, as in
big groups of near copies, are dealt into blocks: first every block meets one
of them, and then pairs of blocks whose members are not linked by that time.

Equal shingle sets form a class first, so exact copies cost one row. Comparing
gives the links of a spanning forest, not all pairs.

Defined results: null or wordless text has an empty set and is linked with
nothing, as are rows without an id (component null, kept). Repeated rows share
the component, and are kept together; the stage keeps one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelathe.llm.common import blank_words_of, buffers, cut, fresh, mixed, slices, small_batches, table, text_key, tidied
from codelathe.llm.components import components, joined

TREES = 5
#: Minwise tokens chosen at each node, and levels; nodes below MIN_LEVEL branch even if they are small.
BRANCH = 2
LEVELS = 4
MIN_LEVEL = 2
#: Minwise hashes that give two bits each to the sketch, and the standard deviations that a candidate may fall short.
SKETCH = 64
MARGIN = 5.5
#: Most members and most shingles of what is compared in one piece.
NODE_ROWS = 3000
NODE_SHINGLES = 4_000_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_LOW_BITS = np.uint64(0x5555555555555555)


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts end to end, and where each text's begin."""
    words, first = blank_words_of(data, at)
    n = len(words)
    key = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        key += words[j : j + len(key)] * _multiplier(j)
    key = mixed(key)
    out, size = [], np.zeros(len(at) - 1, np.int64)
    for i, (b, e) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if e - b >= width:
            s = np.unique(key[b : e - width + 1])
        elif e > b:
            short = np.zeros(1, np.uint64)
            for j in range(b, e):
                short += words[j : j + 1] * _multiplier(j - b)
            s = mixed(short + np.uint64(e - b))
        else:
            continue
        out.append(s)
        size[i] = len(s)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(size)])


def _multiplier(j: int) -> np.uint64:
    return _MULTIPLIERS[j] if j < len(_MULTIPLIERS) else mixed(np.array([j], np.uint64) + _MULTIPLIERS[0])[0] | np.uint64(1)


def minwise(shingles: np.ndarray, begin: np.ndarray, functions: int) -> np.ndarray:
    """(functions, sets) minwise hashes of the non-empty sets that start at ``begin``."""
    if not len(begin):
        return np.zeros((functions, 0), np.uint64)
    seeds = np.random.default_rng(8128).integers(1, 2**63, (functions, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.stack([np.minimum.reduceat((shingles ^ a) * b, begin) for a, b in seeds])


def sketched(minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words for each set: two bits of each of ``SKETCH`` minwise hashes."""
    words = []
    for half in (minima[: SKETCH // 2], minima[SKETCH // 2 : SKETCH]):
        word = np.zeros(minima.shape[1], np.uint64)
        for h in half:
            word = (word << np.uint64(2)) | (h & np.uint64(3))
        words.append(word)
    return words[0], words[1]


def signatures(docs: DataFrame, doc_id: str, text: str, width: int, trees: int = TREES) -> DataFrame:
    """(doc_id, t, c, n, tokens, s, z): digest of the text, class of the set, its size, minwise tokens by tree, level and branch, and the sketch."""
    chosen = trees * LEVELS * BRANCH
    functions = max(chosen, SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                shingles, at = shingle_sets(*buffers(batch.column("text")), width)
                some = np.flatnonzero(np.diff(at))
                minima = mixed(minwise(shingles, at[some], functions))
                one, two, s, z = (np.zeros(len(at) - 1, np.uint64) for _ in range(4))
                if len(some):
                    one[some] = np.add.reduceat(shingles, at[some])
                    two[some] = np.add.reduceat(mixed(shingles + _MULTIPLIERS[1]), at[some])
                    s[some], z[some] = sketched(minima)
                names = np.stack([one, two], 1).tobytes()
                size = np.zeros(len(at) - 1, np.int64)
                size[some] = chosen
                tokens = (minima[:chosen] >> np.uint64(32)).astype(np.uint32).T.ravel().view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(tokens))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array([names[16 * i : 16 * i + 16] for i in range(len(at) - 1)], pa.binary()), pa.array(np.diff(at), pa.int32()), lists, pa.array(s.view(np.int64)), pa.array(z.view(np.int64))], ["doc_id", "t", "c", "n", "tokens", "s", "z"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), _digest(text))
    kind = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("t binary, c binary, n int, tokens array<int>, s long, z long").fields])
    return rows.mapInArrow(tidied(run), kind)


def _digest(text: str):
    return F.unhex(text_key(text)).alias("t")


def least_matches(least: int) -> int:
    """Equal pairs of sketch bits that two sets of ``least`` hundredths similarity have, but for ``MARGIN`` standard deviations."""
    p = least / 100 + (1 - least / 100) / 4
    return max(0, int(np.floor(SKETCH * p - MARGIN * np.sqrt(SKETCH * p * (1 - p)))))


def _matches(s: np.ndarray, z: np.ndarray, other_s: np.ndarray, other_z: np.ndarray) -> np.ndarray:
    differ = np.zeros(np.broadcast_shapes(s.shape, other_s.shape), np.uint8)
    for a, b in ((s, other_s), (z, other_z)):
        x = a ^ b
        differ += np.bitwise_count((x | (x >> np.uint64(1))) & _LOW_BITS)
    return SKETCH - differ


def parts(near: np.ndarray) -> np.ndarray:
    """A number for each row of a symmetric matrix, equal where rows are connected."""
    label = np.full(len(near), -1)
    for i in range(len(near)):
        if label[i] >= 0:
            continue
        label[i] = i
        front = np.array([i])
        while len(front):
            front = np.flatnonzero(near[front].any(0) & (label < 0))
            label[front] = i
    return label


def candidates(nodes: DataFrame, least: int) -> DataFrame:
    """(g, v, lo, n, first) of the members of (node, members) that may be similar: ``g`` names the set of members that hang together in a node, ``lo`` is its least, ``first`` tells the first tree."""
    enough = least_matches(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            flat = lists.flatten()
            v, n, s, z = (flat.field(x).to_numpy() for x in ("v", "n", "s", "z"))
            s, z = s.view(np.uint64), z.view(np.uint64)
            at = np.array(lists.offsets) - (lists.offsets[0].as_py() if len(lists) else 0)
            size = np.diff(at)
            first = (batch.column("node").to_numpy() & 7) == 0
            code = mixed(v.view(np.uint64) + _MULTIPLIERS[2])
            out: list[tuple[np.ndarray, ...]] = []
            # Nodes of two, all at once.
            a = at[:-1][size == 2]
            b = a + 1
            good = (_matches(s[a], z[a], s[b], z[b]) >= enough) & (100 * np.minimum(n[a], n[b]).astype(np.int64) >= least * np.maximum(n[a], n[b]).astype(np.int64))
            a, b, f = a[good], b[good], first[size == 2][good]
            g, lo = mixed(code[a] + code[b]), np.minimum(v[a], v[b])
            out += [(g, v[a], lo, n[a], f), (g, v[b], lo, n[b], f)]
            for i in np.flatnonzero(size > 2).tolist():
                x, y = at[i], at[i + 1]
                size_, many = n[x:y].astype(np.int64), y - x
                near = np.zeros((many, many), bool)
                for p in range(0, many, 512):
                    q = slice(p, p + 512)
                    near[q] = (_matches(s[x:y][q, None], z[x:y][q, None], s[x:y], z[x:y]) >= enough) & (100 * np.minimum(size_[q, None], size_) >= least * np.maximum(size_[q, None], size_))
                label = parts(near)
                kept = np.flatnonzero(np.bincount(label, minlength=many)[label] > 1)
                if not len(kept):
                    continue
                order = kept[np.argsort(label[kept], kind="stable")]
                start = np.flatnonzero(np.append(True, np.diff(label[order]) != 0))
                each = np.diff(np.append(start, len(order)))
                rows = x + order
                g = np.repeat(mixed(np.add.reduceat(code[rows], start)), each)
                lo = np.repeat(np.minimum.reduceat(v[rows], start), each)
                out.append((g, v[rows], lo, n[rows], np.full(len(rows), first[i])))
            g, v, lo, n, f = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(v), pa.array(lo), pa.array(n), pa.array(f)], ["g", "v", "lo", "n", "first"])

    found = nodes.mapInArrow(tidied(run), "g long, v long, lo long, n int, first boolean")
    return found.groupBy("g", "v").agg(F.any_value("lo").alias("lo"), F.any_value("n").alias("n"), F.max("first").alias("first"))


def forest(ids: list, sets: list[np.ndarray], least: int) -> list[tuple]:
    """Links (smallest id, id) of each component of the sets with 100 * |a & b| >= least * |a | b|."""
    m = len(ids)
    sizes = np.array([len(s) for s in sets], np.float64)
    if m == 2:
        both = sizes[0] + sizes[1] - len(np.union1d(*sets))
        return [(min(ids), max(ids))] if 100 * both >= least * (sizes.sum() - both) else []
    flat = np.concatenate(sets)
    values, where, count = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1  # shingles of one member alone are in no intersection
    shared = count[where] > 1
    row, col = np.repeat(np.arange(m), sizes.astype(int))[shared], column[where[shared]]
    both = np.zeros((m, m), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = max(64, min(2048, (16 << 20) // (4 * m)))
    total = int((count > 1).sum())
    for begin in range(0, total, width):
        a, b = np.searchsorted(col, (begin, begin + width))
        x = np.zeros((m, min(width, total - begin)), np.float32)
        x[row[a:b], col[a:b] - begin] = 1
        both += x @ x.T
    near = np.zeros((m, m), bool)
    for i in range(0, m, 256):
        part = both[i : i + 256].astype(np.float64)
        near[i : i + 256] = 100 * part >= least * (sizes[i : i + 256, None] + sizes[None] - part)
    links, open_ = [], np.ones(m, bool)
    for i in sorted(range(m), key=lambda k: ids[k]):
        if not open_[i]:
            continue
        open_[i] = False
        front = [i]
        while front:
            new = np.flatnonzero(near[front].any(0) & open_)
            open_[new] = False
            links += [(ids[i], ids[k]) for k in new.tolist()]
            front = new.tolist()
    return links


def compare(members: DataFrame, width: int, least: int) -> DataFrame:
    """Links (a, b) of ids within each group of (g, v, rep, text); each class v counts once."""
    kind = members.schema["rep"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets, seen = None, [], [], set()
        links: list[tuple] = []

        def end() -> None:
            if len(ids) > 1:
                links.extend(forest(ids, sets, least))

        for whole in batches:
            for batch in slices(whole, "text"):
                flat, at = shingle_sets(*buffers(batch.column("text")), width)
                for k, (g, v, rep) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("g", "v", "rep")))):
                    if g != group:
                        end()
                        group, ids, sets, seen = g, [], [], set()
                    if v not in seen:
                        seen.add(v)
                        ids.append(rep)
                        sets.append(flat[at[k] : at[k + 1]].copy())
                if len(links) > 10_000:
                    yield _links(links)
                    links.clear()
        end()
        yield _links(links)

    def _links(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], arrow), pa.array([b for _, b in rows], arrow)], ["a", "b"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    placed = members.repartition("g").sortWithinPartitions("g", "rep", "v")
    return placed.mapInArrow(tidied(run), T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def child(node, level: int, tree: int) -> list:
    """Children of a node: one for each branch's token. The tree stands in the last three bits."""
    tokens = [F.col("tokens")[(tree * LEVELS + level) * BRANCH + b] for b in range(BRANCH)]
    return [F.xxhash64(node, F.lit(8 * level + b), t).bitwiseAND(F.lit(-8)).bitwiseOR(F.lit(tree)) for b, t in enumerate(tokens)]


def met(classes: DataFrame, trees: int, least: int, node_rows: int, node_shingles: int) -> tuple[DataFrame, DataFrame]:
    """Candidates as :func:`candidates` gives them, and (node, v, k, w) of the nodes that are large at the last level."""
    row = [F.col(x) for x in ("v", "n", "s", "z")]
    nodes = [x for tree in range(trees) for node in child(F.lit(0).cast("long"), 0, tree) for x in child(node, 1, tree)]
    open_ = classes.select(*row, F.explode(F.array(*nodes)).alias("node"))
    found, level = [], MIN_LEVEL
    fits = (F.col("k") <= node_rows) & (F.col("w") <= node_shingles)
    while True:
        stats = cut(open_.groupBy("node").agg(F.count("*").alias("k"), F.sum("n").alias("w")).where("k > 1"))
        # The same plan at every size: neither side is ever broadcast.
        small = open_.join(stats.where(fits).select("node").hint("merge"), "node")
        found.append(candidates(small.groupBy("node").agg(F.collect_list(F.struct(*row)).alias("members")), least))
        large = stats.where(~fits)
        total = large.agg(F.sum("k")).first()[0]
        if not total:
            still = large.select("node", F.lit(0).cast("long").alias("v"), "k", "w").limit(0)
            break
        held = cut(joined(open_, large, "node", "k", total))
        if level == LEVELS:
            still = held.select("node", "v", "k", "w")
            break
        deeper = []
        for tree in range(trees):
            some = held.where(F.col("node").bitwiseAND(F.lit(7)) == tree).join(classes.select("v", "tokens"), "v")
            deeper.append(some.select(*row, F.explode(F.array(*child(F.col("node"), level, tree))).alias("node")))
        open_ = cut(reduce(DataFrame.union, deeper))
        level += 1
    return cut(reduce(DataFrame.union, found).groupBy("g", "v").agg(F.any_value("lo").alias("lo"), F.any_value("n").alias("n"), F.max("first").alias("first"))), still


def dealt(still: DataFrame, first: bool, node_rows: int, node_shingles: int) -> DataFrame:
    """(g, v): blocks of the members of (node, v, k, w), each with the first block, or all other pairs of them."""
    blocks = F.ceil(F.greatest(F.col("k") / (node_rows / 2), F.col("w") / (node_shingles / 2))).cast("int")
    rows = still.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("v", F.lit(29)), F.col("blocks")).cast("int"))
    if first:
        others = F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))
    else:
        others = F.when(F.col("own") > 0, F.sequence(F.lit(1), F.col("blocks") - 1))
    rows = rows.select("v", "node", "own", F.explode(others).alias("other"))
    return rows.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "v")


def texts_of(docs: DataFrame, members: DataFrame, classes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(g, v, rep, text) of the members (g, v)."""
    places = members.groupBy("v").agg(F.collect_list("g").alias("groups")).join(classes.select("v", "rep", "t"), "v")
    rows = docs.select(F.col(doc_id).alias("rep"), F.coalesce(F.col(text), F.lit("")).alias("text"), _digest(text)).where("rep is not null and text <> ''")
    return rows.join(places.hint("merge"), ["rep", "t"]).select(F.explode("groups").alias("g"), "v", "rep", "text")


def linked(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, width: int, least: int, trees: int, node_rows: int, node_shingles: int) -> DataFrame:
    """(rep, component) of the linked classes' ids."""
    pairs, still = met(classes, trees, least, node_rows, node_shingles)
    whole = components(pairs.select(F.col("lo").alias("a"), F.col("v").alias("b")))
    whole = cut(whole.join(pairs.groupBy("v").agg(F.any_value("n").alias("n")), "v"))
    sizes = whole.groupBy("component").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    large = cut(sizes.where((F.col("k") > node_rows) | (F.col("w") > node_shingles)).select("component", "k"))
    total = large.agg(F.sum("k")).first()[0] or 0
    once = whole.join(large, "component", "left_anti").select(F.xxhash64(F.lit(1), "component").alias("g"), "v")
    apart = pairs.join(joined(whole.select("v", "component"), large, "component", "k", total).select("v"), "v") if total else pairs.limit(0)
    more = total > 0 or not still.isEmpty()
    early = once.union(apart.where("first").select("g", "v")).union(dealt(still.where(F.col("node").bitwiseAND(F.lit(7)) == 0), True, node_rows, node_shingles)) if more else once
    links = cut(compare(texts_of(docs, early, classes, doc_id, text), width, least).distinct())
    known = cut(components(links).withColumnRenamed("v", "rep"))
    if not more:
        return known
    # What the first comparisons have joined needs no more.
    now = classes.select("v", "rep").join(known, "rep", "left").select("v", F.coalesce("component", "rep").alias("component"))

    def unsettled(rows: DataFrame, key: str) -> DataFrame:
        mixed_ = rows.join(now, "v").groupBy(key).agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
        return rows.join(mixed_.select(key), key)

    open_ = cut(unsettled(still, "node"))
    elsewhere = open_.where(F.col("node").bitwiseAND(F.lit(7)) != 0)
    late = unsettled(apart.where("not first").select("g", "v").union(dealt(elsewhere, True, node_rows, node_shingles)).union(dealt(open_, False, node_rows, node_shingles)), "g")
    new = cut(compare(texts_of(docs, late.select("g", "v"), classes, doc_id, text), width, least).distinct())
    return cut(components(links.union(new)).withColumnRenamed("v", "rep"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, least: int = 80, trees: int = TREES, node_rows: int = NODE_ROWS, node_shingles: int = NODE_SHINGLES) -> DataFrame:
    """(doc_id, t, n_shingles, component_id, kept) of every row; ``t`` is the digest of its text.

    Shingles have ``width`` words between ASCII white space; rows are linked from
    ``least`` hundredths of Jaccard similarity on.
    """
    small_batches(docs.sparkSession)
    rows = cut(signatures(docs, doc_id, text, width, trees))
    classes = rows.where("n > 0 and doc_id is not null").groupBy("c").agg(F.min(F.struct("doc_id", "t")).alias("r"), *(F.any_value(x).alias(x) for x in ("n", "tokens", "s", "z")))
    # A repeated id may stand for several classes; each is then compared on its own and linked under that id.
    classes = cut(classes.select("c", F.col("r.doc_id").alias("rep"), F.col("r.t").alias("t"), "n", "tokens", "s", "z").withColumn("v", F.monotonically_increasing_id()))
    known = linked(docs, classes, doc_id, text, width, least, trees, node_rows, node_shingles)
    by_class = classes.select(F.col("c").alias("k"), "rep").join(known, "rep", "left").select("k", F.coalesce("component", "rep").alias("component"))
    joined_ = rows.select("doc_id", "t", "c", "n").join(by_class, F.col("c") == F.col("k"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined_.select("doc_id", "t", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, least: int = 80) -> DataFrame:
    """One row of each group, with the columns of ``docs``; rows without an id or words all stay."""
    found = groups(docs, doc_id, text, width, least).where("doc_id is not null and n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias("i"), F.col("t").alias("d")).agg(F.max("kept").alias("kept"), F.count("*").alias("many"))
    first = Window.partitionBy("i").orderBy("d")
    # Only what goes, and what repeats as a whole, is told to the documents.
    told = found.withColumn("keep", F.col("kept") & (F.row_number().over(first) == 1)).where("not keep or many > 1").select("i", "d", "keep")
    key, once = fresh(docs, "near_key"), fresh(docs, "near_row")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.withColumn(key, F.unhex(text_key(text))).join(told.hint("merge"), (F.col(doc_id) == F.col("i")) & (F.col(key) == F.col("d")), "left")
    order = Window.partitionBy(doc_id, key).orderBy(F.lit(0))
    repeated = marked.where("keep").withColumn(once, F.row_number().over(order)).where(F.col(once) == 1)
    return marked.where("keep is null").select(*columns).union(repeated.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return groups(docs, width=3, least=85).select("doc_id", "n_shingles", "component_id", "kept")
