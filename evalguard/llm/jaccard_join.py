"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

1. ``sketch``: one pass over the texts; each text's set of 5-word shingles, its digest and band hashes.
2. Texts with the same set collapse to one node that knows its number of copies.
3. Nodes that share a band hash form candidate components (aggregates and joins on band hashes; no
   pairs are listed, so a hot band costs rows in proportion to its members).
4. Each component is verified on full shingle sets in blocks of about ``BLOCK`` nodes: a task holds two
   blocks at most, computes all their Jaccard similarities as a matrix product, and returns, for each node,
   its number of links and its local class; pairs are never rows.
5. Classes are the connected components of verified links.

The number of bands and rows follows from the wished recall at the threshold (``choose_bands``).

Defined cases: a null, empty or blank text has no shingles and no links; a text of one to four words
has one shingle of all its words, a text without words one of its characters; a very long text is compared whole; pairs at
exactly the threshold are links; rows are told apart by
(doc_id, text), so null and repeated ids keep their rows; the class id is the least doc_id of the class;
an empty table gives an empty result; extra columns are ignored (``keep_one`` returns them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalguard.llm import textvec
from evalguard.llm.common import components, in_arrow, materialise, settle, small

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.9995
MAX_HASHES = 128
BLOCK = 256
_U = np.uint64


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest chance candidates, that reach ``recall`` at ``threshold``."""
    best = (1, 1)
    for rows in range(1, max_hashes + 1):
        share = threshold**rows
        bands = 1 if share >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-share)) if share > 1e-12 else max_hashes + 1
        if bands * rows <= max_hashes:
            best = (max(1, bands), rows)
    return best


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_231)
    return rng.integers(1 << 62, dtype=np.uint64, size=n) * _U(2) + _U(1), rng.integers(1 << 63, dtype=np.uint64, size=n)


def band_hashes(shingles: np.ndarray, bands: int, rows: int, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = family
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):  # a block of hash values that stays in the cache
        part = shingles[at : at + 512, None] * a[None, :]
        part += b[None, :]
        np.minimum(low, part.min(axis=0), out=low)
    low = textvec.mix(low).reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        out = textvec.mix(out * _U(0x9E3779B97F4A7C15) + low[:, j])
    return out


def digest(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh128_digest(shingles.tobytes())


def sketch(docs: DataFrame, width: int = WIDTH, bands: int = 20, rows: int = 5) -> DataFrame:
    """(doc_id, th, node, bands) of each row; node and bands are null where there are no shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = _family(bands * rows)
        for batch in batches:
            nodes, values, offsets = [], [], [0]
            last = (b"", None)
            for s in textvec.shingle_sets(textvec.strings(batch.column(2)), width):
                if len(s):
                    if (d := digest(s)) != last[0]:
                        last = (d, band_hashes(s, bands, rows, family).view(np.int64))
                    values.append(last[1])
                    nodes.append(d)
                else:
                    nodes.append(None)
                offsets.append(offsets[-1] + (bands if len(s) else 0))
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                ["doc_id", "th", "node", "bands"],
            )

    return in_arrow(_keyed(docs), run, "doc_id long, th long, node binary, bands array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def block_links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold, as a symmetric matrix without its diagonal; exact."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    uniq, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size.astype(np.int64))
    shared = count[inverse] > 1  # the others meet nobody
    column = (np.cumsum(count > 1) - 1)[inverse[shared]]
    owner = owner[shared]
    inter = np.zeros((m, m), np.float64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 2048
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        x = np.zeros((m, width), np.float32)
        x[owner[a:b], column[a:b] - first] = 1
        inter += x @ x.T
    links = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-9
    np.fill_diagonal(links, False)
    return links


def local_classes(links: np.ndarray) -> np.ndarray:
    """The least member of each member's connected component."""
    label = np.arange(len(links))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verify(candidates: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """Links and local classes from (comp, bi, bj, block, node, copies, text); a task holds two blocks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, first = [], []
        seen: set[bytes] = set()
        for i, n in enumerate(table["node"].to_pylist()):
            if n not in seen:  # a repeated row brings its text twice
                seen.add(n)
                nodes.append(n)
                first.append(i)
        table = table.take(first)
        order = sorted(range(len(nodes)), key=nodes.__getitem__)
        table, nodes = table.take(order), [nodes[i] for i in order]
        links = block_links(list(textvec.shingle_sets(textvec.strings(table["text"]), width)), threshold)
        block = table["block"].to_numpy()
        if block.min() != block.max():  # two blocks: pairs within each belong to other tasks
            links &= block[:, None] != block[None, :]
        elif table["bi"][0] != table["bj"][0]:
            links[:] = False
        copies = table["copies"].to_numpy()
        label = local_classes(links)
        return pa.table({"node": pa.array(nodes, pa.binary()), "links": pa.array(links @ copies, pa.int64()), "root": pa.array([nodes[i] for i in label], pa.binary()), "blocks": table["blocks"]})

    return candidates.groupBy("comp", "bi", "bj").applyInArrow(run, "node binary, links long, root binary, blocks long")


def classes(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, th, class_id, class_size, n_links) of each row; class_node names the class."""
    bands, rows = choose_bands(threshold, recall)
    s = materialise(sketch(docs, width, bands, rows), "jaccard-sketch")
    some = s.where("node is not null")
    nodes = materialise(
        some.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("rep"), F.first("bands").alias("bands")), "jaccard-nodes"
    )
    spread = nodes.select("node", F.explode("bands").alias("grp"))  # a band's hash holds its number
    shared = spread.groupBy("grp").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("all")).where("n > 1")
    # bands with the same members say the same: one of them is enough
    shared = materialise(shared.groupBy("n", "least", "all").agg(F.min("grp").alias("grp")).select("grp"), "jaccard-bands")
    members = spread.join(shared.hint("merge"), "grp")
    comp = components(members, "node", "grp")
    sizes = materialise(comp.groupBy("comp").agg(F.count("*").alias("size")), "jaccard-sizes")
    placed = comp.join(sizes, "comp").select("comp", "node", F.ceil(F.col("size") / block).alias("blocks")).withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")))
    wanted = materialise(placed.join(nodes.select("node", "copies", "rep.doc_id", "rep.th"), "node"), "jaccard-wanted")
    k, w = _keyed(docs), small(wanted)
    texts = k.join(w, k["doc_id"].eqNullSafe(w["doc_id"]) & (k["th"] == w["th"])).select("comp", "node", "copies", "blocks", "block", "text")
    dealt = texts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("other")
    checked = materialise(verify(dealt, width, threshold), "jaccard-verified")
    far = checked.where("blocks > 1 and node != root or links > 0 and blocks > 1")
    joined = components(far.select("node", F.col("root").alias("grp")).union(far.select(F.col("root").alias("node"), F.col("root").alias("grp"))), "node", "grp")
    near = checked.where("blocks = 1").select("node", "root")
    root = near.union(joined.select("node", F.col("comp").alias("root")))
    found = materialise(
        nodes.join(root, "node", "left").join(checked.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .select("node", "least", "copies", F.coalesce("root", "node").alias("class_node"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "jaccard-found"
    )
    heads = materialise(found.groupBy("class_node").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size")), "jaccard-heads")
    by_node = materialise(found.join(heads, "class_node").select("node", "class_node", "class_id", "class_size", "n_links"), "jaccard-by-node")
    rows_ = some.select("doc_id", "th", "node").join(by_node, "node").select("doc_id", "th", "class_node", "class_id", "class_size", "n_links")
    alone = s.where("node is null").select("doc_id", "th", F.lit(None).cast("binary").alias("class_node"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    return rows_.union(alone)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without all but the first row (least doc_id, null last) of each class; all columns stay."""
    found = settle(docs.sparkSession, lambda: classes(docs, **options), "jaccard-classes")
    rows = found.where("class_node is not null").groupBy("class_node", "doc_id", "th").agg(F.count("*").alias("n"))
    rows = materialise(rows, "jaccard-rows")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = materialise(rows.groupBy("class_node").agg(F.min(key).alias("first")), "jaccard-first")
    marked = rows.join(first, "class_node").withColumn("stays", key == F.col("first"))
    gone = materialise(marked.where("not stays").select("doc_id", "th"), "jaccard-gone")
    again = materialise(marked.where("stays and n > 1").select("doc_id", "th"), "jaccard-again")
    text_hash = F.xxhash64(docs["text"].cast("string"))

    def on(side: DataFrame):
        return docs["doc_id"].cast("long").eqNullSafe(side["doc_id"]) & (text_hash == side["th"])

    g, a = small(gone), small(again)
    kept = docs.join(g, on(g), "left_anti")
    if again.isEmpty():
        return kept
    repeated = docs.join(a, on(a), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(a, on(a), "left_anti").unionByName(repeated)
