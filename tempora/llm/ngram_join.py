"""N-gram Jaccard join with set-relation skipping.

A document's set is its distinct runs of five words (64-bit hashes). Sets link if their Jaccard similarity is 0.75 or more.
The join is exact on the hashes:

1. *Shared elements.* Elements are dealt to partitions by value and counted there; elements of one set alone can only lengthen
   prefixes, so just the shared ones go back to their sets, with their frequency. The few elements so frequent that they would
   crowd one partition (fewer than 2^16, by construction) are found first and handled by value in every task.
2. *Index lists.* Elements are ordered rarest first. Two linked sets must share an element of both prefixes, so only prefixes are
   indexed, and only of sets whose prefix reaches a shared element.
3. *Answers derived from similar sets.* In each list every set is first compared with one pivot. Sets that link to a pivot share its
   component, so nothing inside that component is compared again. The answers of the others of one pivot are derived from what they
   differ in from it.
4. *Block-skip.* What may still link two components of different pivots is searched in the lists alone that span components: a list is
   kept as blocks by set size and position; a pair of blocks whose sizes or positions rule out enough overlap is skipped whole.

Sets equal by hash are one set throughout, and each task merges the copies it reads, so copies are never paired.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_to_keys, shuffle_partitions, written
from .components import connected_components
from .hashing import mix, shingle_hashes, text_chunks, word_hashes

#: An element is frequent if more than this share of all elements are it; so fewer than 2^16 elements are.
FREQUENT_SHARE = 2**-16
#: Elements per partition aimed at while counting.
PARTITION_ELEMENTS = 4_000_000
#: Documents whose elements a task holds at a time.
BATCH_ROWS = 5000
GROUPED = "part int, frequent boolean, elements binary, owners binary, sets binary, sizes binary"


def text_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; none for a text without words."""
    for _, data, ends in text_chunks(texts):
        words, counts = word_hashes(data, ends)
        shingles, n = shingle_hashes(words, counts, width)
        for x in np.split(shingles, np.cumsum(n)[:-1]):
            yield np.unique(x)


def set_id(elements: np.ndarray) -> int:
    """A signed 64-bit name of a set, from all its elements."""
    if not len(elements):
        return 0
    return int(mix(np.array([mix(elements).sum(dtype=np.uint64) + np.uint64(len(elements))], np.uint64)).view(np.int64)[0])


def document_sets(documents: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, set_id, n_shingles of every row; set_id 0 for the empty set."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(set_id(x), len(x)) for x in text_sets(b.column("text"), width)]
            columns = [b.column("doc_id"), *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "set_id", "n_shingles"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(named, "doc_id long, set_id long, n_shingles long")


def frequent_elements(documents: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The frequent elements (sorted), their counts, and the number of all elements.

    An element above the share in all batches is above it in one, so every batch sends those it finds above the share, and the sums
    are held against the share again. Batches differ in copies, so counts are approximate, which only the order of elements sees.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(text_sets(b.column("text"), width))
            elements, n = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_counts=True)
            total = int(n.sum())
            often = n > max(1, total * FREQUENT_SHARE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(elements[often].view(np.int64), 0)), pa.array(np.append(n[often], total)), pa.array(np.append(np.zeros(often.sum(), bool), True))],
                names=["element", "n", "is_total"],
            )

    sums = written(documents.mapInArrow(counted, "element long, n long, is_total boolean").groupBy("element", "is_total").agg(F.sum("n").alias("n")), "frequent")
    total = sums.filter("is_total").agg(F.sum("n")).first()[0] or 0
    found = sums.filter(~F.col("is_total") & (F.col("n") > F.lit(max(64.0, total * FREQUENT_SHARE)))).select("element", "n").toPandas()
    elements = found["element"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(elements)
    return elements[order], found["n"].to_numpy(np.int64)[order], int(total)


def _packed(part: int, frequent: bool, elements: np.ndarray, owners: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple:
    """One row: elements of the sets ``owners`` (ascending numbers into ids and sizes), with just those sets' names."""
    change = np.flatnonzero(np.diff(owners, prepend=-1))
    local = np.cumsum(np.diff(owners, prepend=owners[0] if len(owners) else 0) != 0).astype(np.uint32)
    used = owners[change]
    return part, frequent, elements.tobytes(), local.tobytes(), ids[used].tobytes(), sizes[used].tobytes()


def _grouped(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in GROUPED.split(", ")]
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def _unpacked(table: pa.Table) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
    for f, e, o, s, n in zip(*(table[c].to_pylist() for c in ("frequent", "elements", "owners", "sets", "sizes"))):
        at = np.frombuffer(o, np.uint32)
        yield f, np.frombuffer(e, np.uint64), np.frombuffer(s, np.int64)[at], np.frombuffer(n, np.uint32)[at]


def shared_sets(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """set_id, n (size), n_alone (elements no other set has), prefix (shared elements to index), elements (the shared ones, rarest first).

    Only sets whose prefix reaches a shared element; all others link with nothing but their own copies.
    """
    often, often_n, total = frequent_elements(documents, width)
    parts = max(shuffle_partitions(documents.sparkSession), -(-total // PARTITION_ELEMENTS))
    shared = documents.sparkSession.sparkContext.broadcast((often, often_n))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, _ = shared.value
        for b in (batch.slice(i, BATCH_ROWS) for batch in batches for i in range(0, batch.num_rows, BATCH_ROWS)):
            distinct = {set_id(x): x for x in text_sets(b.column("text"), width) if len(x)}
            if not distinct:
                continue
            ids, sets = np.array(list(distinct), np.int64), list(distinct.values())
            sizes = np.array([len(x) for x in sets], np.uint32)
            elements, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            is_often = np.zeros(len(elements), bool)
            if len(often):
                is_often = often[np.minimum(np.searchsorted(often, elements), len(often) - 1)] == elements
            part = np.where(is_often, mix(ids.view(np.uint64))[owners], elements)
            part = ((part >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64) * 2 + is_often
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            yield _grouped([_packed(int(part[i[0]]) // 2, bool(part[i[0]] % 2), elements[i], owners[i], ids, sizes) for i in np.split(order, cuts)])

    def counted(table: pa.Table) -> pa.Table:
        """Of a range of elements, those that two sets or more have, back by set: ``owners`` holds frequencies here, one for each element."""
        often, often_n = shared.value
        kept: list[tuple[np.ndarray, ...]] = []
        rows = list(_unpacked(table))
        for frequent in (False, True):
            mine = [r[1:] for r in rows if r[0] == frequent]
            if not mine:
                continue
            e, s, n = (np.concatenate([m[k] for m in mine]) for k in range(3))
            if frequent:
                freq = often_n[np.searchsorted(often, e)] + (1 << 40)
            else:
                order = np.argsort(e, kind="stable")
                e, s, n = e[order], s[order], n[order]
                new = np.append(True, e[1:] != e[:-1])
                twice = ~(new & np.append(new[1:], True))
                e, s, n = e[twice], s[twice], n[twice]
            order = np.lexsort((s, e))
            e, s, n = e[order], s[order], n[order]
            if frequent:
                freq = freq[order]
            first = np.ones(len(e), bool)
            first[1:] = (e[1:] != e[:-1]) | (s[1:] != s[:-1])  # copies read by other tasks
            e, s, n = e[first], s[first], n[first]
            if frequent:
                kept.append((e, s, n, freq[first]))
            elif len(e):
                runs = np.append(True, e[1:] != e[:-1])
                freq = np.diff(np.append(np.flatnonzero(runs), len(e)))[np.cumsum(runs) - 1]
                kept.append(tuple(x[freq > 1] for x in (e, s, n, freq.astype(np.int64))))
        out = []
        if kept:
            e, s, n, freq = (np.concatenate([k[i] for k in kept]) for i in range(4))
            part = (mix(s.view(np.uint64)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            for i in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                if len(i):
                    out.append((int(part[i[0]]), False, e[i].tobytes(), freq[i].tobytes(), s[i].tobytes(), n[i].tobytes()))
        return pa.Table.from_batches([_grouped(out)])

    names = "set_id long, n int, n_alone int, prefix int, elements array<bigint>"

    def regrouped(table: pa.Table) -> pa.Table:
        e, freq, s, n = (np.concatenate([np.frombuffer(x, t) for x in table[c].to_pylist()]) for c, t in (("elements", np.uint64), ("owners", np.int64), ("sets", np.int64), ("sizes", np.uint32)))
        order = np.lexsort((e, freq, s))
        e, s, n = e[order], s[order], n[order]
        out: list[tuple] = []
        cuts = np.append(np.flatnonzero(np.append(True, s[1:] != s[:-1])), len(s))
        for i, j in zip(cuts[:-1], cuts[1:]):
            size = int(n[i])
            alone = size - int(j - i)
            reach = size - -(-percent * size // 100) + 1 - alone
            if reach > 0:
                out.append((int(s[i]), size, alone, min(reach, int(j - i)), e[i:j].view(np.int64)))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
        return pa.table({c.split()[0]: pa.array([o[k] for o in out], t) for k, (c, t) in enumerate(zip(names.split(", "), kinds))})

    spread = documents.mapInArrow(dealt, GROUPED).groupBy("part").applyInArrow(counted, GROUPED)
    return spread.groupBy("part").applyInArrow(regrouped, names)


def _may_link(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Sizes and positions (from 0) of a shared prefix element leave room for enough overlap: the position filter."""
    room = 1 + F.least(n1 - p1 - 1, n2 - p2 - 1)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((100 + percent) * room >= percent * (n1 + n2))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, n_a, n_b, alone_b, d (size of the symmetric difference) and diff (its elements that other sets have too)."""
    left = sets.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("elements").alias("e_a"))
    right = sets.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("n_alone").alias("alone_b"), F.col("elements").alias("e_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    diff = F.concat(F.array_except("e_a", "e_b"), F.array_except("e_b", "e_a"))
    return joined.withColumn("d", F.col("n_a") + F.col("n_b") - 2 * F.size(F.array_intersect("e_a", "e_b"))).select("a", "b", "n_a", "n_b", "alone_b", "d", diff.alias("diff"))


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    """Similarity of percent or more, told from sizes and difference: (100 + p) d <= (100 - p) (n_a + n_b)."""
    return compared.filter((100 + percent) * F.col("d") <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _block_pairs(entries: DataFrame, keys: list[str], block: list[Column | str], bounds: list[Column], blocks_may: Callable, pair_may: Callable, fields: list[str]) -> DataFrame:
    """Pairs (a, b) of sets of different components from lists kept as blocks; two blocks that ``blocks_may`` rules out are skipped whole.

    Pairs are tested inside a pair of blocks, so those that ``pair_may`` rules out are never rows.
    """
    blocks = entries.groupBy(*keys, *block).agg(
        *bounds, F.min("component").alias("c_min"), F.max("component").alias("c_max"), F.collect_list(F.struct("set_id", "component", *fields)).alias("members")
    )
    blocks = blocks.withColumn("block", F.struct(*(c for c in ("band", "stretch", "deal") if c in blocks.columns)))
    one, two = blocks.alias("x"), blocks.alias("y")
    same = F.col("x.block") <= F.col("y.block")
    for k in keys:
        same = same & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    alike = (F.col("x.c_min") == F.col("x.c_max")) & (F.col("y.c_min") == F.col("y.c_max")) & (F.col("x.c_min") == F.col("y.c_min"))
    both = one.join(two, same).filter(blocks_may(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")) & ~alike)
    matched = F.flatten(F.transform("x.members", lambda a: F.transform(
        F.filter("y.members", lambda b: (a["component"] != b["component"]) & pair_may(a, b)),
        lambda b: F.struct(F.least(a["set_id"], b["set_id"]).alias("a"), F.greatest(a["set_id"], b["set_id"]).alias("b")),
    )))
    return both.select(F.explode(F.array_distinct(matched)).alias("p")).select("p.a", "p.b").distinct()


def _spanning(entries: DataFrame, keys: list[str], block_sets: int) -> DataFrame:
    """The entries of lists that hold more than one component, each with its ``deal``: by component, and a large component's by set.

    So a block has block_sets sets on average, whether its components are small or one has the whole list.
    """
    parts = entries.groupBy(*keys, "component").agg(F.count("*").alias("own"))
    lists = parts.groupBy(*keys).agg(F.sum("own").alias("length"), F.count("*").alias("components")).filter("components > 1").drop("components")
    parts = parts.join(lists, keys)
    deals = F.struct(F.pmod(F.xxhash64("component"), F.ceil(F.col("length") / block_sets)).alias("list"), F.pmod(F.xxhash64("set_id"), F.ceil(F.col("own") / block_sets)).alias("part"))
    return entries.join(parts, [*keys, "component"]).withColumn("deal", deals).drop("own", "length")


def _derived_pairs(first: DataFrame, labels: DataFrame | None, percent: int, block_sets: int) -> DataFrame:
    """Pairs (a, b) of different components and one pivot that may link, from what each differs in from the pivot alone.

    The difference of two sets is that of their differences from the pivot x: d(y, z) = d(x, y) + d(x, z) - 2 c, where c counts common
    elements of both differences, among them always those that x has alone. With g = (100 + p) d - (100 - p) n two sets link if
    g(y) + g(z) <= 2 (100 + p) c. So few differences prove a link without any look (a star to the least g covers all such pairs),
    and otherwise enough common differences must be found: a prefix join over the differences, rare ones first, in which the many
    elements that one edit alone brought in rule out nearly every pair.
    """
    whole, part = 100 + percent, 100 - percent
    members = first.select(F.col("a").alias("set_id"), F.col("b").alias("pivot"), F.col("alone_b").alias("alone"), "diff", (whole * F.col("d") - part * F.col("n_a")).cast("long").alias("g"))
    members = _labelled(members, labels)
    groups = members.groupBy("pivot").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct("g", "set_id")).alias("best"), F.min_by("component", F.struct("g", "set_id")).alias("best_component"), F.count("*").alias("n"))
    members = written(joined_to_keys(members, groups.filter("lo <> hi").drop("lo", "hi"), "pivot", first.count()), "differences")
    sure = members.filter((F.col("component") != F.col("best_component")) & (F.col("g") + F.col("best.g") <= 2 * whole * F.col("alone"))).select(F.col("set_id").alias("a"), F.col("best.set_id").alias("b"))
    rows = members.select("pivot", "set_id", F.explode("diff").alias("element"))
    shared = rows.groupBy("pivot", "element").agg(F.count("*").alias("k")).filter("k > 1")
    lists = rows.join(shared, ["pivot", "element"]).groupBy("pivot", "set_id").agg(F.sort_array(F.collect_list(F.struct("k", "element"))).alias("e"))
    least = F.greatest(F.ceil((F.col("g") + F.col("best.g")) / (2 * whole)) - F.col("alone"), F.lit(1)).cast("int")
    kept = members.drop("diff").join(lists, ["pivot", "set_id"]).withColumn("m", F.size("e")).withColumn("reach", F.col("m") - least + 1).filter("reach > 0")
    entries = kept.select("pivot", "set_id", "component", "alone", "g", "m", F.posexplode(F.slice("e", F.lit(1), F.col("reach"))).alias("position", "x")).withColumn("element", F.col("x.element")).drop("x")
    needed = lambda g1, g2, alone: F.ceil((g1 + g2) / (2 * whole)) - alone
    pairs = _block_pairs(
        _spanning(entries, ["pivot", "element"], block_sets), ["pivot", "element"], ["deal"],
        [F.min("g").alias("g_min"), F.min("alone").alias("alone"), F.max(F.col("m") - F.col("position")).alias("r_max")],
        lambda x, y: needed(x("g_min"), y("g_min"), x("alone")) <= F.least(x("r_max"), y("r_max")),
        lambda a, b: needed(a["g"], b["g"], a["alone"]) <= F.least(a["m"] - a["position"], b["m"] - b["position"]),
        ["alone", "g", "m", "position"],
    )
    return sure.unionByName(pairs)


def set_components(documents: DataFrame, width: int = 5, percent: int = 75, pivot_rounds: int = 3, block_sets: int = 128) -> DataFrame:
    """node, component: set ids and the least set id they reach by links, for sets that have a link."""
    sets = written(shared_sets(documents.select(F.col("text").cast("string")), width, percent), "sets")
    index = sets.select("set_id", "n", "n_alone", "prefix", F.posexplode(F.slice("elements", F.lit(1), F.col("prefix"))).alias("k", "element"))
    index = index.select("element", "set_id", "n", "prefix", (F.col("n_alone") + F.col("k")).alias("position"))
    listed = index.groupBy("element").agg(F.count("*").alias("length")).filter("length > 1").select("element")
    index = written(index.join(listed, "element"), "index")
    labels: DataFrame | None = None
    links: DataFrame | None = None
    first: DataFrame | None = None
    for r in range(pivot_rounds):
        now = _labelled(index, labels)
        # one pivot for each list, then the best pivot of another component for each set; at first the set that is in most lists,
        # which is the one that differs least from its group, later any component by hash
        place = F.struct((-F.col("prefix") if r == 0 else F.lit(0)).alias("p"), F.xxhash64("component", F.lit(r)).alias("h"))
        pivot = now.groupBy("element").agg(F.min(F.struct(place.alias("at"), F.col("component"), F.col("set_id"), F.col("n"), F.col("position"))).alias("p"))
        near = now.join(pivot, "element").filter((F.col("component") != F.col("p.component")) & _may_link(F.col("n"), F.col("position"), F.col("p.n"), F.col("p.position"), percent))
        votes = near.groupBy("set_id", F.col("p.set_id").alias("pivot")).agg(F.count("*").alias("votes"))
        pairs = votes.groupBy("set_id").agg(F.max(F.struct("votes", "pivot")).alias("best")).select(F.col("set_id").alias("a"), F.col("best.pivot").alias("b"))
        compared = written(_compared(pairs, sets), "compared")
        first = compared if first is None else first
        found = _linked(compared, percent)
        if compared.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        labels = connected_components(links)
    # what may still link sets of one pivot, from their differences
    found = written(_linked(_compared(_derived_pairs(first, labels, percent, block_sets), sets), percent), "links")
    links = found if links is None else links.unionByName(found)
    labels = connected_components(links)
    # and all others, from the lists that span components
    pivots = first.select(F.col("a").alias("set_id"), F.col("b").alias("pivot"))
    now = _labelled(index, labels).join(pivots, "set_id", "left").withColumn("pivot", F.coalesce("pivot", "set_id"))
    pairs = _block_pairs(
        _spanning(now, ["element"], block_sets), ["element"],
        # sizes within a tenth of each other, positions within an eighth of the size, and block_sets sets at most on average
        [F.floor(F.log(F.col("n")) / F.lit(float(np.log(1.1)))).alias("band"), F.floor(8 * F.col("position") / F.col("n")).alias("stretch"), "deal"],
        [F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.max(F.col("n") - F.col("position")).alias("r_max"), F.min("pivot").alias("v_min"), F.max("pivot").alias("v_max")],
        lambda x, y: (100 * F.least(x("n_max"), y("n_max")) >= percent * F.greatest(x("n_min"), y("n_min")))
        & ((100 + percent) * F.least(x("r_max"), y("r_max")) >= percent * (x("n_min") + y("n_min")))
        & ~((x("v_min") == x("v_max")) & (y("v_min") == y("v_max")) & (x("v_min") == y("v_min"))),
        lambda a, b: (a["pivot"] != b["pivot"]) & (a["pivot"] != b["set_id"]) & (b["pivot"] != a["set_id"]) & _may_link(a["n"], a["position"], b["n"], b["position"], percent),
        ["n", "position", "pivot"],
    )
    found = written(_linked(_compared(pairs, sets), percent), "links")
    return connected_components(links.unionByName(found))


def _labelled(index: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The index with each set's component so far: itself where it has no link yet."""
    if labels is None:
        return index.withColumn("component", F.col("set_id"))
    return index.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))


def ngram_jaccard_groups(documents: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id: the size of each document's set and the smallest doc_id that it reaches by links.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a text of fewer than ``width`` words is one shingle. Null and empty
    texts have the empty set, which links with nothing: component_id is the own doc_id. Rows with a null doc_id count as members but
    not as the smallest. Repeated rows are rows of their own in one component. No documents give no rows.
    """
    sets = written(document_sets(documents, width), "document-sets")
    components = set_components(documents, width, percent)
    # sets first, so that copies of one set are one row; then components, of which the few large ones are not shuffled
    per_set = sets.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    per_set = per_set.join(components.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    per_set = written(per_set, "set-components")
    least = written(per_set.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "components")
    found = joined_to_keys(per_set.drop("least"), least, "component", per_set.count()).select("set_id", "component_id")
    copies = sets.filter("n_shingles > 0").groupBy("set_id").agg(F.count("*").alias("n"))
    named = written(found.join(copies, "set_id"), "set-names")
    filled = joined_to_keys(sets.filter("n_shingles > 0"), named, "set_id", sets.count())
    empty = sets.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return filled.unionByName(empty).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i+4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
r as (select doc_id as a, doc_id as b from d union select r.a, e.b from r join e on r.b = e.a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.component_id
from d left join n using (doc_id) join (select a as doc_id, min(b) as component_id from r group by 1) c using (doc_id)
"""
