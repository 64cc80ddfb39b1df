"""Near-duplicate components by HyperMinHash.

A text's set is its distinct five-word shingles. Texts with equal sets are one
class. Each class gets 256 registers: a shingle's hash picks a register, and
the register keeps the smallest rest of a hash as a count of leading zeros
plus mantissa bits. Empty registers of small sets borrow from filled ones at
places that depend on the register alone. Bands of compressed registers find
candidates; their registers give an estimate of the Jaccard similarity, less
the collisions to be expected; pairs that may reach the limit are confirmed on
the full sets.

No group is expanded into all its pairs. First each class is compared with the
hubs of its buckets, and links found are joined into components. Then, in small
buckets, classes outside the bucket's main component are compared with classes
of other components; in large ones, pairs are found by what they have in common
that sets them off from one base text of their group, rare edits first. Both ways keep every pair of
different components that shares a bucket and can reach the limit, so no link
between them is lost that the bands find. Rows of a band follow from ``percent``: a pair
at the limit shares no band with a probability of at most ``MISS`` (3e-6 at 80,
9e-7 at 85; below 5 % one row is not enough for that).

Defined results: a text without words, or a null text, has the empty set and is
linked with nothing. A row with a null key shares the component of the rows
with its set; a set that null keys alone have is linked with nothing and has no
component id. Rows repeated with one key share its component; the texts of a
key that has several count as one node. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingmill.llm.common import batches_of, slices, stored
from filingmill.llm.words import mix, shingle_sets

REGISTERS = 256
MANTISSA_BITS = 10
#: Most that a pair at the limit may miss all bands.
MISS = 1e-5
#: Parts of a group of equal sets when it is gathered.
PARTS = 64
#: Standard deviations that an estimate may fall short of the limit.
MARGIN = 5.0
#: Classes of a bucket above which pairs are sought by differences to its hub.
HOT = 16
#: Most ids that are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_EMPTY = np.uint16(0xFFFF)
_TRIES = mix(np.arange(64 * REGISTERS, dtype=np.uint64)).reshape(64, REGISTERS) % np.uint64(REGISTERS)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers per set; all empty for an empty set."""
    low = np.full((len(sets), REGISTERS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i, s in enumerate(sets):
        # Sorted hashes: the first of each register has the smallest rest.
        which = (s >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.diff(which, prepend=-1))
        low[i, which[first]] = s[first] << np.uint64(8)
    filled = low != np.iinfo(np.uint64).max
    fraction, exponent = np.frexp((low >> np.uint64(11)).astype(np.float64))
    zeros = np.where(low >> np.uint64(11) == 0, 53, 53 - exponent)
    mantissa = np.floor((2 * fraction - 1).clip(0) * (1 << MANTISSA_BITS)).astype(np.int64)
    value = (zeros << MANTISSA_BITS | mantissa).astype(np.uint16)
    out = np.where(filled, value, _EMPTY)
    source = out.copy()
    some = filled.any(axis=1)
    for picks in _TRIES:
        need = (out == _EMPTY) & some[:, None]
        if not need.any():
            return out
        out = np.where(need, source[:, picks.astype(np.int64)], out)
    for i in np.flatnonzero(((out == _EMPTY).any(axis=1)) & some):
        at = np.flatnonzero(source[i] != _EMPTY)
        gaps = np.flatnonzero(out[i] == _EMPTY)
        out[i, gaps] = source[i, at[np.searchsorted(at, gaps) % len(at)]]
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, less the collisions to be expected.

    Minima of different shingles fall into one cell of the compressed scale
    with a probability near 0.72 / 2^mantissa bits x na nb / (na + nb)^2.
    """
    equal = (a == b).mean(axis=1)
    chance = 0.72 / (1 << MANTISSA_BITS) * na * nb / (na + nb) ** 2
    return (equal - chance) / (1 - chance)


def _signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, set size, set fingerprint and registers of each row."""
    names = ["key", "n", "fa", "fb", "regs"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in slices(texts):
                sets = list(shingle_sets(texts[part.start:part.stop]))
                regs = registers(sets)
                fa = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
                fb = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                columns = [
                    batch.column(0).slice(part.start, len(part)),
                    [len(s) for s in sets], fa, fb, [r.tobytes() for r in regs],
                ]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names
                )

    rows = docs.select(F.col(key).cast("long"), F.col(text).cast("string"))
    return rows.mapInArrow(run, "key long, n long, fa long, fb long, regs binary")


def band_rows(percent: int) -> int:
    """Most rows of a band at which a pair at the limit is found but for ``MISS``."""
    rows = 1
    while rows < REGISTERS and (1 - (percent / 100) ** (rows + 1)) ** (REGISTERS // (rows + 1)) <= MISS:
        rows += 1
    return rows


def _bands(classes: DataFrame, percent: int) -> DataFrame:
    """(bucket, class, set size) for each band of each class."""
    length = band_rows(percent)
    count = REGISTERS // length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = np.arange(1, count + 1, dtype=np.uint64)
        place = mix(np.arange(1, length + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint16)
            regs = regs.reshape(-1, REGISTERS)[:, :count * length].reshape(-1, count, length)
            keys = mix(((regs.astype(np.uint64) + np.uint64(1)) * place).sum(axis=2) + mix(turn))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64).ravel()),
                 pa.array(np.repeat(batch.column(0).to_numpy(), count)),
                 pa.array(np.repeat(batch.column(1).to_numpy(), count))],
                ["bucket", "cls", "n"],
            )

    return classes.select("cls", "n", "regs").mapInArrow(run, "bucket long, cls long, n long")


def _promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose estimate leaves the limit possible."""
    limit = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
                for i in (4, 5)
            )
            na, nb = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
            free = np.minimum(np.minimum(na, nb), 200)
            least = limit - MARGIN * np.sqrt(limit * (1 - limit) / free)
            good = pa.array(estimate(a, b, na, nb) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(good)

    side = lambda s: classes.select(
        F.col("cls").alias(s), F.col("n").alias(f"n{s}"), F.col("regs").alias(f"r{s}")
    )
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .select("a", "b", "na", "nb", "ra", "rb")
        .mapInArrow(run, "a long, b long")
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.uint64) for c in (2, 3))
                small, large = (a, b) if len(a) < len(b) else (b, a)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum())
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], ["a", "b"]
            ).filter(pa.array(good, pa.bool_()))

    side = lambda s: sets.select(F.col("cls").alias(s), F.col("items").alias(f"s{s}"))
    return (
        pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
        .mapInArrow(run, "a long, b long")
    )


def _full_sets(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """Sorted shingle hashes of the texts whose keys are in ``ids``."""
    size = ids.count()
    ids = ids.select(F.col("rep").alias("_rep"), "cls")
    if size <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text"))
    picked = rows.join(ids, F.col("_key") == F.col("_rep")).select("cls", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in slices(texts):
                items = [s.tobytes() for s in shingle_sets(texts[part.start:part.stop])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, len(part)), pa.array(items, pa.binary())],
                    ["cls", "items"],
                )

    return picked.mapInArrow(run, "cls long, items binary")


def components(edges: DataFrame) -> DataFrame:
    """(cls, comp) of every class on an edge; comp is the smallest reachable.

    Each round gives a node the smallest label next to it and then the label
    of that label; rounds end when nothing changes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.distinct(), "edges")
    labels = stored(
        both.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.first("a")).alias("comp")),
        "labels",
    )
    while True:
        near = both.join(labels.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(
            F.min("comp").alias("near")
        )
        step = labels.join(near, "cls", "left").select(
            "cls", "comp", F.least("comp", F.coalesce("near", "comp")).alias("low")
        )
        jump = labels.select(F.col("cls").alias("low"), F.col("comp").alias("far"))
        nxt = stored(
            step.join(jump, "low", "left").select(
                "cls",
                F.least("low", F.coalesce("far", "low")).alias("comp"),
                (F.least("low", F.coalesce("far", "low")) < F.col("comp")).alias("moved"),
            ),
            "labels",
        )
        labels = nxt.select("cls", "comp")
        if nxt.where("moved").isEmpty():
            return labels


def _with_hubs(buckets: DataFrame) -> DataFrame:
    """Each row of a bucket with the bucket's size and hub.

    The hub is the class with the most company in all its buckets: in a group
    of edited copies it is the text they were made from, or close to it.
    """
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
    company = buckets.join(sizes, "bucket").groupBy("cls").agg(F.sum("m").alias("company"))
    hubs = buckets.join(company, "cls").groupBy("bucket").agg(
        F.max(F.struct("company", "cls", "n")).alias("top"), F.count(F.lit(1)).alias("m")
    )
    return buckets.join(
        hubs.select(
            "bucket", "m", F.col("top.cls").alias("hub"), F.col("top.n").alias("nh"), F.col("top.company").alias("company")
        ),
        "bucket",
    )


def _with_bases(hot: DataFrame) -> DataFrame:
    """Large buckets with their base: the text that all members are set off from.

    It is the hub with the most company among the hubs that the bucket's own
    hub meets in large buckets, so the many buckets of one group of copies have
    one base, and each copy is compared with it once and not once for each hub.
    """
    hubs = hot.select(F.col("hub").alias("cls")).distinct()
    bases = hot.join(hubs, "cls").groupBy(F.col("cls").alias("hub")).agg(
        F.max(F.struct("company", F.col("hub").alias("base"), "nh"))["base"].alias("base"),
        F.max(F.struct("company", "hub", "nh"))["nh"].alias("nb"),
    )
    return hot.join(bases, "hub").select("base", "cls", "n", "nb").distinct()


def _star_pairs(buckets: DataFrame, based: DataFrame, percent: int) -> DataFrame:
    """Each class with the hubs and the bases of its buckets."""
    centres = buckets.select("cls", "n", "hub", "nh").unionByName(
        based.select("cls", "n", F.col("base").alias("hub"), F.col("nb").alias("nh"))
    )
    return (
        centres.where(f"cls <> hub AND 100 * least(n, nh) >= {percent} * greatest(n, nh)")
        .select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b"))
        .distinct()
    )


def _rest_pairs(marked: DataFrame, percent: int) -> DataFrame:
    """Pairs of one small bucket and different components.

    One side is outside the bucket's main component.
    """
    counts = marked.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("size"))
    main = counts.groupBy("bucket").agg(
        F.max(F.struct("size", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("comps")
    ).where("comps > 1").select("bucket", "main")
    open_rows = marked.select("bucket", "cls", "n", "comp").join(main, "bucket")
    others = open_rows.where("comp <> main").select(
        "bucket", F.col("cls").alias("c1"), F.col("n").alias("n1"), F.col("comp").alias("k1")
    )
    return (
        others.join(open_rows, "bucket")
        .where(
            "comp <> k1 AND (comp = main OR c1 < cls) AND "
            f"100 * least(n, n1) >= {percent} * greatest(n, n1)"
        )
        .select(F.least("cls", "c1").alias("a"), F.greatest("cls", "c1").alias("b"))
        .distinct()
    )


def _hot_pairs(based: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of a large bucket that may be linked though not both to its base.

    A class differs from the base by the symmetric difference D of the sets.
    Sets x and y at the limit differ by at most t = c (|x| + |y|) shingles,
    c = (100 - percent) / (100 + percent), so their D share o = (|Dx| + |Dy| -
    t) / 2 shingles at least. If o is 0 or less, both are linked to the base.
    Otherwise, in any fixed order, the first shingle they share stands among
    the first |D| - o + 1 of both, and enough follow it. The order is by the
    number of classes that differ from the base by a shingle, rarest first, so
    that an edit which thousands of classes have in common is the last to be
    met at. Shingles of one class alone meet nothing and are only counted.
    """
    c = (100 - percent) / (100 + percent)
    members = based.where("cls <> base").select("base", "cls", "n").join(labels, "cls", "left")
    own = labels.select(F.col("cls").alias("base"), F.col("comp").alias("base_comp"))
    members = members.withColumn("comp", F.coalesce("comp", "cls")).join(own, "base", "left").withColumn(
        "near", F.col("comp") == F.coalesce("base_comp", "base")
    )
    # A base whose members are all linked to it has no pair left to find.
    open_bases = members.where("NOT near").select("base").distinct()
    with_sets = members.join(open_bases, "base").join(
        sets.select("cls", F.col("items").alias("mine")), "cls"
    ).join(sets.select(F.col("cls").alias("base"), F.col("items").alias("theirs")), "base")
    names = ["base", "cls", "n", "comp", "near", "d", "item"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = []
            for i in range(batch.num_rows):
                mine, theirs = (np.frombuffer(batch.column(k)[i].as_buffer(), dtype=np.uint64) for k in ("mine", "theirs"))
                both.append(np.setxor1d(mine, theirs, assume_unique=True))
            counts = [len(d) for d in both]
            if sum(counts):
                at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
                columns = [batch.column(k).take(at) for k in names[:5]]
                columns.append(pa.array(np.repeat(counts, counts).astype(np.int64)))
                columns.append(pa.array(np.concatenate(both).view(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "base long, cls long, n long, comp long, near boolean, d long, item long"
    edits = stored(with_sets.mapInArrow(run, schema), "edits")
    held = stored(
        edits.groupBy("base", "item").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "held"
    )
    line = Window.partitionBy("base", "cls")
    ranked = edits.join(held, ["base", "item"]).withColumns(
        {"rank": F.row_number().over(line.orderBy("held", "item")), "common": F.count(F.lit(1)).over(line)}
    )
    first = F.when(F.col("near"), F.floor(F.col("d") * (1 + c) / 2)).otherwise(
        F.floor(F.col("n") * c * (1 + 100 / percent))
    ) + 2
    firsts = stored(
        ranked.withColumn("place", F.col("d") - F.col("common") + F.col("rank") - 1)
        .where(F.col("place") < first).drop("held", "rank", "common"),
        "firsts",
    )
    others = firsts.where("NOT near").select(
        "base", "item", *[F.col(k).alias(f"{k}1") for k in ("cls", "n", "comp", "d", "place")]
    )
    return (
        others.join(firsts, ["base", "item"])
        .where(
            "comp <> comp1 AND (near OR cls1 < cls) AND "
            f"100 * least(n, n1) >= {percent} * greatest(n, n1) AND "
            f"2 * least(d - place, d1 - place1) >= d + d1 - {c!r} * (n + n1) - 1e-6"
        )
        .select(F.least("cls", "cls1").alias("a"), F.greatest("cls", "cls1").alias("b"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Component of each row, by links of at least ``percent`` % similarity.

    Returns the key, ``n_shingles``, ``component_id`` and ``kept``.
    """
    batches_of(docs.sparkSession)
    signed = stored(_signatures(docs, key, text), "signatures")
    part = F.pmod(F.xxhash64("key"), F.lit(PARTS))
    rows = signed.select("key", "n", "fa", "fb", F.concat_ws(":", "fa", "fb", part).alias("spot"))
    parts = rows.where("n > 0").groupBy("spot").agg(
        F.min("key").alias("low"), F.first("fa").alias("fa"), F.first("fb").alias("fb")
    )
    names = parts.groupBy("fa", "fb").agg(F.min("low").alias("cls"))
    reps = signed.where("n > 0").join(
        names.select(F.col("fa").alias("_fa"), F.col("fb").alias("_fb"), "cls"),
        (F.col("key") == F.col("cls")) & (F.col("fa") == F.col("_fa")) & (F.col("fb") == F.col("_fb")),
    )
    classes = stored(
        reps.groupBy("cls", "fa", "fb").agg(F.first("n").alias("n"), F.first("regs").alias("regs")),
        "classes",
    )
    bands = _bands(classes, percent)
    shared = bands.groupBy("bucket").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x < y")
    buckets = stored(_with_hubs(stored(bands.join(shared.select("bucket"), "bucket"), "shared")), "buckets")
    sets = stored(
        _full_sets(docs, buckets.select("cls", F.col("cls").alias("rep")).distinct(), key, text), "sets"
    )

    def links(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        tried = stored(_promising(pairs, classes, percent), f"{name}-pairs")
        return stored(_confirmed(tried, sets, percent), f"{name}-links"), tried

    based = stored(_with_bases(buckets.where(F.col("m") > HOT)), "based")
    first, tried = links(_star_pairs(buckets, based, percent), "star")
    linked = components(first)
    marked = stored(
        buckets.join(linked, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "marked"
    )
    cold = _rest_pairs(marked.where(F.col("m") <= HOT), percent)
    hot = _hot_pairs(based, linked, sets, percent)
    rest = cold.unionByName(hot).distinct().join(tried, ["a", "b"], "left_anti")
    second, _ = links(rest, "rest")
    labels = components(first.unionByName(second))
    decided = names.join(labels, "cls", "left").select(
        "fa", "fb", F.coalesce("comp", "cls").alias("component")
    )
    spots = parts.select("spot", "fa", "fb").join(decided, ["fa", "fb"]).select("spot", "component")
    placed = rows.join(spots, "spot", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key"))
    return placed.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"),
    )


def first_of_components(docs: DataFrame, decisions: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns unchanged.

    A key goes if none of its rows is kept. Only the keys that go are joined.
    """
    gone = decisions.groupBy(F.col(key).alias("_gone")).agg(F.bool_or("kept").alias("stays")).where("NOT stays")
    return docs.join(gone.select("_gone"), docs[key].eqNullSafe(F.col("_gone")), "left_anti")
