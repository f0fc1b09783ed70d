"""Documents with nearly the same word n-grams: a Jaccard self-join by MinHash bands.

Every text is a set of hashes of ``size`` consecutive words. Texts with equal sets are folded
to one node, with its number of documents. MinHash values are cut into bands; rows per band and
number of bands are chosen for a target recall at the threshold. Nodes are shuffled on band
hashes; nodes that share one are candidates. Candidates are gathered in connected groups, whose
full sets are compared in blocks of at most ``block`` nodes: every pair of blocks is one task, so a group of any
size is spread, and links are counted there and never written as pairs. Of each task's links
only a spanning forest leaves it; its connected components are the classes.

Result, one row per document: ``class_id`` is the smallest id among the documents connected by
links, ``copy_id`` the smallest among those of the same set, ``n_links`` the number of other
documents whose similarity reaches the threshold.

Defined results: words are runs of characters other than ASCII white space, unchanged; a text
of fewer words than ``size`` has one n-gram, all its words; a text without words (or null) has no
links and is a class of its own; documents with a null id have no links and a null class;
repeated ids are separate documents. Sets are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm import common
from labelloom.llm.graph import components
from labelloom.llm.words import BYTE_VALUES, Powers, find_words, mix, span_hashes, utf8
from labelloom.session import store_table

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STEP = U(0xC2B2AE3D27D4EB4F)


def choose_bands(threshold: float, recall: float, most_values: int = 128) -> tuple[int, int]:
    """Bands and rows per band: the most rows for which bands reach the recall at the threshold."""
    for rows in range(most_values, 0, -1):
        bands = 1
        while 1 - (1 - threshold**rows) ** bands < recall and bands * rows <= most_values:
            bands += 1
        if bands * rows <= most_values:
            return bands, rows
    return most_values, 1


def shingles(column: pa.Array, size: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, one text after the other, and how many each has."""
    data, offsets = utf8(column)
    words = find_words(data, offsets, ~_SPACE[data])
    hashes = span_hashes(BYTE_VALUES[data], words.starts, words.ends, powers)
    counts = words.per_text()
    n_grams = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    text = np.repeat(np.arange(len(counts)), n_grams)
    within = np.arange(len(text)) - np.repeat(np.cumsum(n_grams) - n_grams, n_grams)
    at = words.first[:-1][text] + within
    width = np.minimum(counts[text], size)
    grams = np.zeros(len(text), U)
    for j in range(size):
        live = width > j
        grams[live] = grams[live] * _STEP + hashes[at[live] + j]
    grams = mix(grams)
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    return grams[new], np.bincount(text[new], minlength=len(counts))


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U)) | U(1)


def _nodes(grams: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """16 bytes that stand for each set, null for those without n-grams."""
    full = counts > 0
    nodes = np.zeros((len(counts), 2), U)
    if full.any():
        first = (np.cumsum(counts) - counts)[full]
        nodes[full, 0] = np.add.reduceat(mix(grams ^ _STEP), first)
        nodes[full, 1] = np.add.reduceat(mix(grams + _STEP), first) ^ counts[full].astype(U)
    raw = nodes.tobytes()
    return [raw[16 * i : 16 * i + 16] if f else None for i, f in enumerate(full)]


def _documents(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """doc_id, text_hash and text. An id and the hash of the text together tell repeated ids apart."""
    named = F.col(id_column).cast("long").alias("doc_id")
    return docs.select(named, F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def sketch(docs: DataFrame, id_column: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, node (16 bytes that stand for the set, null without words) and band hashes."""
    factors = _multipliers(bands * rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for start, stop in common.text_slices(batch.column(2)):
                part = batch.slice(start, stop - start)
                grams, counts = shingles(part.column(2), size, powers)
                full = counts > 0
                first = (np.cumsum(counts) - counts)[full]
                keys = np.zeros((len(counts), bands), U)
                if full.any():
                    for band in range(bands):
                        key = np.full(len(first), U(band + 1))
                        for factor in factors[band * rows : (band + 1) * rows]:
                            key = mix(key * _STEP + np.minimum.reduceat(grams * factor, first))
                        keys[full, band] = key
                width = pa.array(np.arange(0, bands * (len(counts) + 1), bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(_nodes(grams, counts), pa.binary()),
                        pa.ListArray.from_arrays(width, pa.array(keys.view(np.int64).ravel())),
                    ],
                    names=["doc_id", "text_hash", "node", "bands"],
                )

    rows_in = _documents(docs, id_column, text)
    return rows_in.mapInArrow(run, "doc_id bigint, text_hash bigint, node binary, bands array<bigint>")


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """node and component of nodes that share a band hash with another."""
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most")
    links = keys.join(shared.select("key", "least"), "key").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return components(links)


def _sets(docs: DataFrame, wanted: DataFrame, id_column: str, text: str, size: int) -> DataFrame:
    """``wanted`` (doc_id, text_hash, node, …) with the n-gram set of each node as bytes."""
    texts = _documents(docs, id_column, text)
    # Never broadcast, however few they are: the plan is the same at every size.
    rows = texts.join(wanted.hint("merge"), ["doc_id", "text_hash"]).select("text", "node", "component", "block", "blocks", "weight")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for start, stop in common.text_slices(batch.column(0)):
                part = batch.slice(start, stop - start)
                grams, counts = shingles(part.column(0), size, powers)
                ends, data = 8 * np.cumsum(counts), grams.tobytes()
                sets = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                found = pa.RecordBatch.from_arrays(
                    [pa.array(sets, pa.binary()), *part.columns[1:]], names=["grams", *part.schema.names[1:]]
                )
                # Another text of the same id and hash is another set.
                yield found.filter(pc.equal(pa.array(_nodes(grams, counts), pa.binary()), part.column(1)))

    return rows.mapInArrow(run, "grams binary, node binary, component binary, block int, blocks int, weight bigint")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of 0/1 matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    common_grams = np.intersect1d(a, b)
    if not len(common_grams):
        return out
    spots = []
    for grams, sets in ((a, left), (b, right)):
        at = np.minimum(np.searchsorted(common_grams, grams), len(common_grams) - 1)
        hit = common_grams[at] == grams
        spots.append((at[hit], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit]))
    for low in range(0, len(common_grams), chunk):
        marks = []
        for (column, row), sets in zip(spots, (left, right), strict=True):
            inside = (column >= low) & (column < low + chunk)
            m = np.zeros((len(sets), min(chunk, len(common_grams) - low)), np.float32)
            m[row[inside], column[inside] - low] = 1
            marks.append(m)
        out += marks[0] @ marks[1].T
    return out


def _compare(threshold: Fraction):
    """One task: all links of a block, or between two blocks, of one group."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        first, second = key[1].as_py(), key[2].as_py()
        seen: dict[bytes, int] = {}
        for i, node in enumerate(rows.column("node").to_pylist()):
            seen.setdefault(node, i)  # a repeated row may bring a set twice
        rows = rows.take(pa.array(sorted(seen.values()), pa.int64()))
        nodes = rows.column("node").to_pylist()
        block = rows.column("block").to_numpy()
        weight = rows.column("weight").to_numpy()
        sets = [np.frombuffer(g, U) for g in rows.column("grams").to_pylist()]
        left = np.flatnonzero(block == first)
        right = left if first == second else np.flatnonzero(block == second)
        links = np.zeros(len(nodes), np.int64)
        roots = list(range(len(nodes)))

        def root(i: int) -> int:
            while roots[i] != i:
                roots[i] = i = roots[roots[i]]
            return i

        edges = []
        if len(left) and len(right):
            sizes = np.array([len(s) for s in sets])
            same = _overlaps([sets[i] for i in left], [sets[i] for i in right]).astype(np.int64)
            union = sizes[left][:, None] + sizes[right][None, :] - same
            linked = same * threshold.denominator >= union * threshold.numerator
            if first == second:
                np.fill_diagonal(linked, False)
            links[left] += linked @ weight[right]
            if first != second:
                links[right] += weight[left] @ linked
            for i, j in zip(*np.nonzero(linked), strict=True):
                a, b = root(int(left[i])), root(int(right[j]))
                if a != b:
                    roots[a] = b
                    edges.append((nodes[left[i]], nodes[right[j]]))
        out = [(n, int(k), None) for n, k in zip(nodes, links, strict=True) if k] + [(a, 0, b) for a, b in edges]
        return pa.table(
            {
                "node": pa.array([x[0] for x in out], pa.binary()),
                "links": pa.array([x[1] for x in out], pa.int64()),
                "other": pa.array([x[2] for x in out], pa.binary()),
            }
        )

    return run


def join_near(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    size: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9999,
    block: int = 256,
) -> DataFrame:
    """One row per document: doc_id, class_id, copy_id, n_links. See the module's text."""
    return _join(docs, id_column, text, size, threshold, recall, block).drop("text_hash")


def _join(docs: DataFrame, id_column: str, text: str, size: int, threshold: float, recall: float, block: int) -> DataFrame:
    """The result of :func:`join_near` with ``text_hash``."""
    bands, rows = choose_bands(threshold, recall)
    sketches = store_table(sketch(docs, id_column, text, size, bands, rows))
    known = sketches.where("node is not null and doc_id is not null")
    nodes = known.groupBy("node").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("weight"), F.min_by("bands", "doc_id").alias("bands")
    )
    nodes = nodes.select("node", F.col("first.doc_id").alias("copy_id"), F.col("first.text_hash").alias("text_hash"), "weight", "bands")
    nodes = store_table(nodes)
    groups = store_table(candidate_groups(nodes))
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    wanted = (
        groups.join(sizes, "component")
        .withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
        .withColumn("block", place)
        .join(nodes.select("node", "copy_id", "text_hash", "weight"), "node")
        .select(F.col("copy_id").alias("doc_id"), "text_hash", "node", "component", "block", "blocks", "weight")
    )
    sets = _sets(docs, store_table(wanted), id_column, text, size)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - F.lit(1)))
    paired = sets.withColumn("other", other).select(
        "grams", "node", "component", "block", "weight",
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
    )
    found = paired.groupBy("component", "i", "j").applyInArrow(
        _compare(Fraction(threshold).limit_denominator(1000)), "node binary, links bigint, other binary"
    )
    found = store_table(found)
    linked = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    members = nodes.select("node", "copy_id", "weight").join(classes, "node", "left").join(linked, "node", "left")
    heads = members.where("component is not null").groupBy("component").agg(F.min("copy_id").alias("class_id"))
    facts = store_table(
        members.join(heads, "component", "left").select(
            "node",
            F.coalesce("class_id", "copy_id").alias("class_id"),
            "copy_id",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - F.lit(1)).alias("n_links"),
        )
    )
    own = sketches.select("doc_id", "text_hash", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    return own.join(facts, "node", "left").select(
        "doc_id",
        "text_hash",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    size: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9999,
    block: int = 256,
) -> DataFrame:
    """Rows of ``docs`` without those that :func:`join_near` links to a document of a smaller id.

    Of rows with the class's smallest id (a repeated id) all of the same text are one row.
    """
    found = _join(docs, id_column, text, size, threshold, recall, block)
    keep = found.where("class_id = doc_id").select("doc_id", "text_hash").distinct()
    keep = keep.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    named = docs.where(F.col(id_column).isNotNull())
    same = (F.col(id_column).cast("long") == F.col("_id")) & (F.xxhash64(text) == F.col("_hash"))
    kept = named.join(keep, same, "left_semi").dropDuplicates([id_column, text])
    return kept.select(docs.columns).unionByName(docs.where(F.col(id_column).isNull()))
