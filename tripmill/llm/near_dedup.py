"""MinHash near-dedup by a chosen-path similarity join (after Christiani, Pagh and Sivertsen, 2018).

A document's set holds its distinct shingles of ``width`` words (64-bit hashes of the ASCII-lower-cased words). Documents whose
Jaccard similarity is at least ``threshold`` are linked; a component is one group of near copies.

1. Sketch: MinHash values of every set, the key of the set, and for each of ``trees`` independent trees a path of four minwise tokens.
2. Equal sets become one class, by an aggregate; only one member of each goes on.
3. Chosen paths. Each tree starts from all classes and branches by a minwise token. A node with at most ``small`` members
   is compared exhaustively on the sketches, at a similarity so far below the threshold that a linked pair practically never fails; one
   with more branches by the next token, node by node. From the fourth level on a node that is still large either has members that
   mostly resemble its least one, and is joined to it as a star at once (which merges too much, never too little), or branches
   into two children a member, up to ``extra`` times, by tokens of the sketch at places that differ from node to node. A linked pair shares a node of depth d with a chance of at least
   threshold**d in each tree and independently, so all trees miss it with a chance of at most (1 - threshold**d)**trees: 3e-8 at
   depth 3, 3e-6 at depth 4. The connected groups of all trees are the candidate groups: no link leaves its group.
4. Links are confirmed on full sets, rebuilt from the whole texts, within candidate groups of at most ``block`` members with at most
   ``heavy`` shingles in all, which are compared as a whole. Other groups, of many members or of long texts, are first sorted by ``orders`` MinHash
   orders and compared in blocks of as many neighbours, or shingles, which overlap by half, so that no task holds a large group. A block gives
   the star of each of its components, never all pairs. What the blocks leave in several parts is then joined exactly
   (``links_across``): block and heavy bound memory, and no pair is left out for either.
5. Components of the confirmed links, and every document gets that of its class.

Null texts and texts without words have the empty set and are linked with nothing. A text with fewer words than ``width`` is a
set of one. Rows without doc_id are returned, linked with nothing, component null, kept. Rows that repeat a doc_id belong to one
component. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, byte_column, join_by_share, list_slices, runs, small_slices, table
from .components import connected_components
from .textkernel import LOWER, blake_keys, mix, pair_hashes, word_hashes

VALUES, TRUNK, BAND = 64, 4, 1.06
SKETCH = "doc_id long, n_shingles long, k1 long, k2 long, paths array<long>, sig binary"


def shingle_sets(column: pa.Array, width: int = 2) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf, offs = byte_column(column)
    words, first = word_hashes(LOWER[buf], offs)
    grams = words
    for k in range(1, width):  # a hash of k + 1 words from that of k and the next word
        grams = pair_hashes(grams[:-1], words[k:]) if len(grams) > 1 else words[:0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        else:
            whole = words[a : a + 1]
            for k in range(a + 1, b):
                whole = pair_hashes(whole, words[k : k + 1])
            yield mix(whole) if b > a else whole[:0]


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    return int(hashes.sum(dtype=np.uint64).view(np.int64)), int(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))


def minima(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.full(len(keys), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):  # bounded memory for long texts
        np.minimum(out, ((hashes[i : i + 2048, None] * keys) >> np.uint64(24)).min(axis=0), out=out)
    return out


def sketcher(trees: int, width: int) -> Callable:
    """A path holds TRUNK tokens of 16 bits each, the first lowest."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = blake_keys("near", VALUES + trees * TRUNK)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        for whole in batches:
            for batch in small_slices(whole, "text"):
                rows: list[list] = [[], [], [], [], []]
                for s in shingle_sets(batch.column(1), width):
                    if len(s):
                        low = mix(minima(s, keys))
                        path = (low[VALUES:] & np.uint64(0xFFFF)).astype("<u2").reshape(trees, TRUNK).copy().view("<i8")[:, 0]
                        row = (len(s), *set_key(s), path, (low[:VALUES] & np.uint64(0xFF)).astype(np.uint8).tobytes())
                    else:
                        row = (0, 0, 0, None, None)
                    for column, value in zip(rows, row):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(r, t) for r, t in zip(rows, types[1:]))], names=["doc_id", "n_shingles", "k1", "k2", "paths", "sig"])

    return sketch


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def compare_nodes(floor: int) -> Callable:
    """Exhaustive comparison of small nodes on their sketches: rows at each distance within a node, all at once."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "node"):
            part = part.combine_chunks()
            node, rep = part.column("node").to_numpy(), part.column("rep").to_numpy()
            sig = byte_column(part.column("sig").combine_chunks())[0].reshape(-1, VALUES)
            found: list[np.ndarray] = []
            at, step = np.arange(len(node)), 1
            while True:
                at = at[at + step < len(node)]
                at = at[node[at] == node[at + step]]
                if not len(at):
                    break
                for i in range(0, len(at), 20_000):
                    near = at[i : i + 20_000]
                    near = near[(sig[near] == sig[near + step]).sum(axis=1) >= floor]
                    found.append(np.stack([near, near + step]))
                step += 1
            a, b = np.concatenate(found, axis=1) if found else (node[:0], node[:0])
            label = stars(len(node), a.astype(np.int64), b.astype(np.int64))
            far = rep != rep[label]
            yield pa.RecordBatch.from_arrays([pa.array(rep[far]), pa.array(rep[label][far])], names=["u", "v"])

    return compare


def linked(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a < b) with 100 * intersection >= percent * union, from the incidence of shared shingles."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        ok = 100 * both >= percent * (sizes.sum() - both)
        return np.zeros(int(ok), int), np.ones(int(ok), int)
    flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    often = np.diff(np.r_[start, len(flat)])
    column = np.repeat(np.arange(len(start)), often)
    shared = np.repeat(often > 1, often)
    column, who = np.unique(column[shared], return_inverse=True)[1] if shared.any() else column[:0], who[shared]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = max(64, 2_000_000 // len(sets))
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + width, width))
    for k, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
        if i < j:
            hit = np.zeros((len(sets), width), np.float32)
            hit[who[i:j], column[i:j] - k * width] = 1
            both += hit @ hit.T
    both = np.rint(both).astype(np.int64)
    a, b = np.nonzero(np.triu(100 * both >= percent * (sizes[:, None] + sizes - both), 1))
    return a, b


def lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column of longs, as unsigned numbers."""
    flat, offs = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].tolist()
    return [flat[a:b] for a, b in zip(offs[:-1], offs[1:])]


def set_rows(width: int) -> Callable:
    """The full set of each row's text, if it is the set of the row's class."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_slices(whole, "text"):
                at = batch.schema.get_field_index
                got = list(shingle_sets(batch.column(at("text")), width))
                k1, k2 = (batch.column(at(k)).to_pylist() for k in ("k1", "k2"))
                own = pa.array([len(s) > 0 and set_key(s) == k for s, k in zip(got, zip(k1, k2))], pa.bool_())
                sets = pa.array([s.view(np.int64) for s in got], pa.list_(pa.int64()))
                columns = [batch.column(at(c)) for c in ("grp", "rep", "large", "sig")]
                yield pa.RecordBatch.from_arrays([*columns, sets], names=["grp", "rep", "large", "sig", "tokens"]).filter(own)

    return rows


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by grp and rep without those that repeat both: copies of a document's row are no members of their own."""
    last = None
    for batch in batches:
        if batch.num_rows:
            at = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("grp", "rep")])
            new = np.r_[last is None or (at[:, 0] != last).any(), (at[:, 1:] != at[:, :-1]).any(axis=0)]
            last = at[:, -1]
            yield batch.filter(pa.array(new))


def confirmer(percent: int, block: int, heavy: int) -> Callable:
    """Sets sorted by grp -> the stars of the components of each group, or of each block of one over ``block`` rows or ``heavy`` shingles."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs((s for b in once(batches) for s in list_slices(b, "tokens")), "grp", block, "tokens", heavy):
            part = part.combine_chunks()
            grp, rep, sets = part.column("grp").to_numpy(), part.column("rep").to_numpy(), lists(part.column("tokens").combine_chunks())
            cuts = np.r_[np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]]), len(grp)]
            us, vs = [], []
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                for at in range(i, max(i + 1, j - block // 2), max(1, block // 2)):  # one round unless the run is long
                    to = min(j, at + block)
                    if to - at > 1:
                        us.append(rep[at:to]), vs.append(rep[at:to][stars(to - at, *linked(sets[at:to], percent))])
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])

    return confirm


def links_across(sets: DataFrame, parts: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The pairs of parts (u, v) of a group of ``sets`` (grp, rep, tokens) that a link connects, where ``parts`` (rep, part) are the
    components of the links known so far; what is in none is a part of its own.

    An exact join by prefix, length and position filters, which lose no link: with tokens in order of rarity within the group, the first
    common token of a linked pair comes so early in both sets that enough are left. How early depends on both sizes, so sets are
    joined by the band of the smaller size. Pairs within the largest part of a group, which may be most of it, are not generated.
    """
    ids = sets.select("grp", "rep").join(parts, "rep", "left").withColumn("part", F.coalesce("part", "rep"))
    main = ids.groupBy("grp", "part").agg(F.count("*").alias("m")).groupBy("grp").agg(F.count("*").alias("parts"), F.max(F.struct("m", "part"))["part"].alias("main"))
    ids = scratch.keep(ids.join(main.where("parts > 1"), "grp").select("rep", "part", (F.col("part") == F.col("main")).alias("main")), "parts")
    # no more than keys goes with every token; what belongs to a set comes back when only its first tokens are left
    one = lambda *more: sets.join(ids, "rep").select("grp", "rep", *more, F.explode("tokens").alias("token"))
    often = scratch.keep(one("part").groupBy("grp", "token").agg(F.count("*").alias("often"), (F.min("part") < F.max("part")).alias("across")), "often")
    tokens = join_by_share(one(), often, ["grp", "token"], "often")
    # rarest first: a pair whose first common token comes later has too few left for a link
    head = tokens.withColumn("nth", F.row_number().over(W.partitionBy("rep").orderBy("often", "token"))).withColumn("n", F.count("*").over(W.partitionBy("rep")))
    head = head.where(f"across AND 100 * (n - nth + 1) >= {percent} * n").withColumn("band", F.floor(F.log("n") / float(np.log(BAND))).cast("int"))
    head = scratch.keep(head.join(ids, "rep").select("grp", "rep", "part", "main", "n", "token", "nth", "band"), "head")
    scratch.drop(often)
    smaller = head.where(f"{100 + percent} * (n - nth + 1) >= {2 * percent} * n").selectExpr("grp", "token", "band", "main AS side", "rep AS u", "part AS pu", "n AS nu", "nth AS iu")
    steps = int(np.log(100 / percent) / np.log(BAND)) + 1
    larger = head.withColumn("band", F.explode(F.expr(f"transform(sequence(0, {steps}), d -> band - d)")))
    larger = larger.where(f"{100 + percent} * (n - nth + 1) >= {percent} * (n + greatest(power({BAND}D, band), {percent / 100}D * n)) - 1e-6")
    # side: that of the smaller set; a set in the main part meets only sets outside of it
    larger = larger.withColumn("side", F.explode(F.when(F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    larger = larger.selectExpr("grp", "token", "band", "side", "rep AS v", "part AS pv", "n AS nv", "nth AS iv")
    # by shuffle: the table's size on disk says nothing of what its rows grow to, so it must not be taken for small
    pairs = smaller.join(larger.hint("merge"), ["grp", "token", "band", "side"]).where(
        f"pu <> pv AND (nu < nv OR nu = nv AND u < v) AND 100 * nu >= {percent} * nv AND {100 + percent} * (1 + least(nu - iu, nv - iv)) >= {percent} * (nu + nv)"
    )
    pairs = scratch.keep(pairs.select("u", "v", "pu", "pv").distinct(), "pairs")
    full = sets.select(F.col("rep").alias("u"), F.col("tokens").alias("tu"))
    pairs = pairs.join(full, "u").join(full.withColumnsRenamed({"u": "v", "tu": "tv"}), "v")
    shared = pairs.withColumn("shared", F.size(F.array_intersect("tu", "tv")))
    return scratch.keep(shared.where(f"100 * shared >= {percent} * (size(tu) + size(tv) - shared)").select(F.col("pu").alias("u"), F.col("pv").alias("v")), "across")


def chosen_paths(reps: DataFrame, scratch: Scratch, floor: int, trees: int, small: int, extra: int) -> DataFrame:
    """(rep, paths, sig) -> (u, v) whose connected components are the candidate groups."""
    sigs = reps.select("rep", "sig")
    nodes = reps.select("rep", F.posexplode("paths").alias("tree", "path")).select("rep", F.xxhash64("tree", F.col("path").bitwiseAND(F.lit(0xFFFF))).alias("node"), F.shiftrightunsigned("path", 16).alias("path"))
    edges: list[DataFrame] = []
    few: list[DataFrame] = []
    done: list[DataFrame] = []
    for level in range(1, TRUNK + extra + 1):
        size = nodes.groupBy("node").agg(F.count("*").alias("members"), F.min("rep").alias("least")).where("members > 1")
        shared = scratch.keep(nodes.join(size, "node"), f"nodes{level}")
        done.append(shared)
        few.append(shared.where(F.col("members") <= small).select("node", "rep"))
        many = shared.where(F.col("members") > small)
        if level < TRUNK:
            nodes = many.select("rep", F.xxhash64("node", F.col("path").bitwiseAND(F.lit(0xFFFF))).alias("node"), F.shiftrightunsigned("path", 16).alias("path"))
            if many.isEmpty():
                break
            continue
        many = many.join(sigs, "rep").join(sigs.toDF("least", "least_sig"), "least")
        alike = F.expr(f"aggregate(sequence(1, {VALUES}), 0, (a, i) -> a + IF(substring(sig, i, 1) = substring(least_sig, i, 1), 1, 0)) >= {floor}")
        many = scratch.keep(many.select("node", "rep", "least", "sig", alike.alias("alike")), f"many{level}")
        done.append(many)
        many = many.join(many.groupBy("node").agg(F.avg(F.col("alike").cast("int")).alias("share")), "node")
        whole = F.col("share") >= 0.5 if level < TRUNK + extra else F.lit(True)
        edges.append(scratch.keep(many.where(whole).select(F.col("rep").alias("u"), F.col("least").alias("v")), f"stars{level}"))
        done.append(edges[-1])
        # the place is the same for all members of a node, and another in every tree
        token = lambda b: F.expr(f"substring(sig, 1 + CAST(pmod(xxhash64(node, {level}, {b}), {VALUES - 1}) AS INT), 2)")  # noqa: B023, E731
        nodes = many.where(~whole).select("rep", F.explode(F.array(*(F.xxhash64("node", F.lit(b), token(b)) for b in (0, 1)))).alias("node"))
        if nodes.isEmpty():
            break
    # the small nodes of all levels are compared in one go
    compared = reduce(DataFrame.union, few).join(sigs, "rep").select("node", "rep", "sig").repartition("node").sortWithinPartitions("node", "rep")
    candidates = reduce(DataFrame.union, edges, compared.mapInArrow(compare_nodes(floor), "u long, v long"))
    groups = scratch.keep(connected_components(candidates, scratch), "groups").toDF("rep", "grp")
    scratch.drop(*done)
    return groups


def near_duplicates(docs: DataFrame, *, percent: int = 80, width: int = 2, trees: int = 24, small: int = 32, extra: int = 2, block: int = 512, heavy: int = 4 << 20, orders: int = 12, slack: float = 4.5) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept.

    percent: the least similarity of a link in hundredths. width: words in a shingle. block, heavy: members and shingles of a group that one
    task compares as a whole. slack: standard deviations by which a sketch may
    fall short.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = scratch.keep(docs.mapInArrow(sketcher(trees, width), SKETCH), "sketch")
    usable = sketch.where("n_shingles > 0 and doc_id is not null")
    reps = usable.groupBy("n_shingles", "k1", "k2").agg(F.min(F.struct("doc_id", "sig", "paths")).alias("m"))
    reps = scratch.keep(reps.select(F.col("m.doc_id").alias("rep"), "n_shingles", "k1", "k2", "m.sig", "m.paths"), "classes")
    j = percent / 100
    floor = max(1, int(VALUES * j - slack * (VALUES * j * (1 - j)) ** 0.5))
    groups = chosen_paths(reps, scratch, floor, trees, small, extra)

    sized = groups.join(reps.select("rep", "n_shingles", "k1", "k2", "sig"), "rep")
    sizes = sized.groupBy("grp").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("weight"))
    large = (F.col("members") > block) | ((F.col("members") > 1) & (F.col("weight") > heavy))
    sized = sized.join(sizes.select("grp", large.alias("large")), "grp")
    sets = sized.join(docs.withColumnRenamed("doc_id", "rep"), "rep").mapInArrow(set_rows(width), "grp long, rep long, large boolean, sig binary, tokens array<long>")
    sets = scratch.keep(sets, "sets")
    confirm = confirmer(percent, block, heavy)
    plain = sets.where("NOT large").select("grp", "rep", "tokens").repartition("grp").sortWithinPartitions("grp", "rep")
    big = sets.where("large").dropDuplicates(["rep"])
    turned = lambda o: F.concat(F.expr(f"substring(sig, {1 + 5 * o % VALUES}, {VALUES})"), F.expr(f"substring(sig, 1, {5 * o % VALUES})"))
    orders_ = F.explode(F.array(*(F.struct(F.lit(o).alias("o"), turned(o).alias("place")) for o in range(orders))))
    turns = big.withColumn("x", orders_).select(F.xxhash64("grp", "x.o").alias("grp"), "x.place", "rep", "tokens")
    turns = turns.repartitionByRange("grp", "place", "rep").sortWithinPartitions("grp", "place", "rep").select("grp", "rep", "tokens")
    links = plain.mapInArrow(confirm, "u long, v long").union(turns.mapInArrow(confirm, "u long, v long"))
    doubled = usable.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "k1", "k2")).alias("a"), F.max(F.struct("n_shingles", "k1", "k2")).alias("b")).where("a != b").select("doc_id")
    classes = reps.select("n_shingles", "k1", "k2", "rep")
    same_id = usable.join(doubled, "doc_id").join(classes, ["n_shingles", "k1", "k2"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    links = scratch.keep(links.union(same_id), "links")
    parts = scratch.keep(connected_components(links, scratch), "parts").toDF("rep", "part")
    classes = classes.join(parts, "rep", "left").withColumn("component", F.coalesce("part", "rep"))
    if not big.isEmpty():
        across = links_across(scratch.keep(big.select("grp", "rep", "tokens"), "big"), parts, scratch, percent)
        if not across.isEmpty():
            merged = scratch.keep(connected_components(across, scratch), "merged").toDF("component", "final")
            classes = classes.join(merged, "component", "left").withColumn("component", F.coalesce("final", "component"))
    scratch.drop(sets)
    classes = classes.select("n_shingles", "k1", "k2", "component")
    out = sketch.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["n_shingles", "k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, *, width: int = 5, **options) -> DataFrame:
    """The documents, by shingles of five words, with one of each component, with their columns: that of the smallest doc_id, of rows that repeat it the one
    with the smallest text. Rows without doc_id stay."""
    kept = near_duplicates(docs, width=width, **options).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct()
    first = W.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    known = docs.join(kept, docs.doc_id == kept["__id"]).withColumn("__nth", F.row_number().over(first)).where("__nth = 1")
    return known.select(docs.columns).union(docs.where("doc_id IS NULL"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
c AS (SELECT min(doc_id) AS c, s FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
e AS (SELECT c, len(s) AS n, unnest(s) AS x FROM c),
p AS (
  SELECT a.c AS a, b.c AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.x = b.x AND a.c <> b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.c, b.c),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 80 * (na + nb - shared)),
r AS (SELECT c AS a, c AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.m, s.doc_id) AS component_id, coalesce(m.m, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.s = list_sort(s.s) AND len(s.s) > 0 LEFT JOIN m ON m.a = c.c
"""
QUERIES = {"op9_near_dedup": op9_near_dedup}
ORACLES = {"op9_near_dedup": SQL}
