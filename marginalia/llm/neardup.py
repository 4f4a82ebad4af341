"""MinHash near-duplicate groups with fast similarity sketches.

Every document is reduced to its set of distinct word shingles (A-Z lower-cased).  A sketch has
``COORDS`` coordinates; in round i every shingle is hashed to one bin and to a value that starts with
i, and a bin keeps its least value, so early rounds win and hashing stops once all bins are full.  In
the last ``COORDS`` rounds round i fills bin i - COORDS, so no bin stays empty and the estimate keeps
its concentration bounds.  Bands of coordinates propose pairs; full sets confirm them.

Hot groups: equal sets collapse to one row first.  In a bucket of k different sets, members are
compared with the bucket's least and greatest id only (2k pairs, not k squared).  Once those links have
been merged, members whose bucket still holds several components are compared in blocks inside a task:
a pair whose sketches agree within four standard deviations is confirmed on its sets there, and only
links leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.bytewords import U64, grams, join2, mix, word_batches
from marginalia.llm.graph import components
from marginalia.llm.rowkeys import keyed
from marginalia.llm.store import cut

SHINGLE, PERCENT = 5, 75
COORDS, BAND = 112, 4
BLOCK = 2048  # members that one task compares at a time

_SEEDS = mix(np.arange(1, 2 * COORDS + 1, dtype=U64) * U64(0xD1342543DE82EF95))


def shingle_set(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes; a text of fewer words counts as one shingle, one without words as none."""
    if len(words) >= n:
        return np.unique(grams(words, n))
    return grams(words, len(words)) ^ U64(len(words)) if len(words) else np.zeros(0, U64)


def _rounds(shingles: np.ndarray, seeds: np.ndarray, t: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins, and their least values, of the rounds with these seeds."""
    h = mix(shingles[None, :] ^ seeds[:, None])
    bins = ((h >> U64(32)) * U64(t)) >> U64(32)
    value = (np.arange(first, first + len(seeds), dtype=U64)[:, None] << U64(49)) | (mix(h) >> U64(15))
    keys = np.sort(((bins << U64(57)) | value).ravel())
    bins = keys >> U64(57)
    lead = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    return bins[lead].astype(np.int64), keys[lead] & U64((1 << 57) - 1)


def sketch(shingles: np.ndarray, t: int = COORDS) -> np.ndarray:
    """Fast similarity sketch of a non-empty set.  Stopping early does not change it: a later round's
    value is never less than one of an earlier round."""
    need = min(t, math.ceil(t * (math.log(t) + 3) / len(shingles)))
    out = np.zeros(t, U64)
    bins, values = _rounds(shingles, _SEEDS[:need], t, 0)
    if len(bins) < t and need < t:
        bins, values = _rounds(shingles, _SEEDS[:t], t, 0)
    out[bins] = values
    if len(bins) < t:
        empty = np.setdiff1d(np.arange(t), bins)
        h = mix(mix(shingles[None, :] ^ _SEEDS[t + empty][:, None]))
        out[empty] = ((t + empty).astype(U64) << U64(49)) | (h.min(axis=1) >> U64(15))
    return out


def bands(coords: np.ndarray, rows: int = BAND) -> np.ndarray:
    parts = coords.reshape(-1, rows)
    key = mix(np.arange(len(parts), dtype=U64) + U64(11))
    for k in range(rows):
        key = join2(key, parts[:, k])
    return key.view(np.int64)


_SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, coords binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for part in word_batches(batch.column(1), lower=True):
            n, d1, d2, keys, coords = [], [], [], [], []
            for a, b in zip(part.first[:-1], part.first[1:], strict=True):
                s = shingle_set(part.words[a:b])
                n.append(len(s))
                with np.errstate(over="ignore"):
                    d1.append(int(mix(s).sum(dtype=U64).astype(np.int64)))
                    d2.append(int(mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64).astype(np.int64)))
                c = sketch(s) if len(s) else None
                keys.append(bands(c) if len(s) else np.zeros(0, np.int64))
                coords.append(mix(c).astype(np.uint16).tobytes() if len(s) else b"")
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(part.rows.start, part.rows.stop - part.rows.start), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64())), pa.array(coords, pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "coords"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in word_batches(batch.column(1), lower=True):
            sets = [shingle_set(part.words[a:b]).tobytes() for a, b in zip(part.first[:-1], part.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.rows.start, len(sets)), pa.array(sets, pa.binary())], names=["rep", "shingles"])


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sx"), batch.column("sy"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                both = np.sort(np.concatenate([a, b]))
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(good, pa.bool_()))

    return confirm


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (x, y) that hold on the full sets.  y may be one id for many pairs: its side of the last
    join is unique, and the other side can be split where it is skewed."""
    own = sets.select(F.col("rep").alias("x"), F.col("shingles").alias("sx"))
    other = sets.select(F.col("rep").alias("y"), F.col("shingles").alias("sy"))
    return pairs.join(own, "x").join(other, "y").select("x", "y", "sx", "sy").mapInArrow(_confirm(percent), "x long, y long")


_LEAST_EQUAL = math.floor(COORDS * PERCENT / 100 - 4 * math.sqrt(COORDS * PERCENT / 100 * (1 - PERCENT / 100)))


def _cross_links(percent: int):
    def cross_links(group: pd.DataFrame) -> pd.DataFrame:
        """Links between different components of one block: of each probe one link to each component."""
        group = group.drop_duplicates(["rep", "probe"])
        coords = np.frombuffer(b"".join(group["coords"]), np.uint16).reshape(len(group), COORDS)
        ids, component, probe = group["rep"].to_numpy(), group["component"].to_numpy(), group["probe"].to_numpy()
        sets = [np.frombuffer(v, U64) for v in group["shingles"]]
        size = np.array([len(s) for s in sets])
        there = np.flatnonzero(~probe)
        found = []
        for i in np.flatnonzero(probe):
            most, least = np.maximum(size[there], size[i]), np.minimum(size[there], size[i])
            rest = there[(component[there] != component[i]) & (100 * least >= percent * most)]
            rest = rest[(coords[rest] == coords[i]).sum(axis=1) >= _LEAST_EQUAL]
            if not len(rest):
                continue
            pool = np.concatenate([sets[k] for k in rest])
            at = np.minimum(np.searchsorted(sets[i], pool), size[i] - 1)
            shared = np.add.reduceat((sets[i][at] == pool).astype(np.int64), np.cumsum(size[rest]) - size[rest])
            good = rest[100 * shared >= percent * (size[i] + size[rest] - shared)]
            _, one = np.unique(component[good], return_index=True)
            found += [(ids[i], ids[k]) for k in good[one]]
        return pd.DataFrame(found, columns=["x", "y"], dtype=np.int64)

    return cross_links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least id reachable over links with
    100 * shared >= percent * union), kept.

    Null or word-less texts have no shingles and link with nothing; texts of any length are read whole; an
    empty table gives an empty one.  A null id takes no part in links: component_id is null and the row is
    kept.  Rows of one id are one document whatever their texts: each links by its own text, and all share
    a component.  Other columns of ``docs`` are not read, whatever their names.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named, names = keyed(source.where("doc_id is not null"))
    source = named.withColumnRenamed("key", "doc_id")
    nameless = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is null")
    signed = cut(source.mapInArrow(_sign, _SIGNED))

    # equal sets: one representative, the least id
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    same = usable.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    member = cut(usable.select("doc_id", "n_shingles", "d1", "d2").distinct().join(same, ["n_shingles", "d1", "d2"]).select("doc_id", "rep"))
    reps = usable.join(member.where("doc_id = rep").select("rep").distinct(), F.col("doc_id") == F.col("rep")).select("rep", "bands", "coords").dropDuplicates(["rep"])

    # buckets with two representatives or more
    placed = reps.select("rep", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    seat = cut(placed.join(shared, "key"))
    ends = seat.select(F.col("rep").alias("x"), F.explode(F.array("lo", "hi")).alias("y")).where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    seated = seat.select("rep").distinct()
    sets = cut(source.where("doc_id is not null").join(seated, F.col("doc_id") == F.col("rep"), "left_semi").mapInArrow(_sets, "rep long, shingles binary").dropDuplicates(["rep"]))
    links = cut(confirmed(ends, sets, percent))
    merged = components(links.toDF("a", "b"))

    # A bucket of two or three has had all its pairs confirmed.  Larger ones that still hold several
    # components gather under their largest one, each member once; members of smaller components (the
    # probes) meet all others there, in blocks of bounded size, and only links are returned.
    label = seat.where("size > 3").join(merged, seat["rep"] == merged["node"], "left").select("rep", "key", F.coalesce("component", "rep").alias("component"))
    counts = label.groupBy("key", "component").count()
    main = counts.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("n")).where("n > 1").select("key", "main")
    parts = cut(label.join(main, "key").select("main", "rep", "component").distinct())
    sizes = parts.groupBy("main").agg(F.count("*").alias("members"), F.count_if(F.col("component") != F.col("main")).alias("probes"))
    blocks = {c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int") for c in ("members", "probes")}
    parts = parts.join(sizes, "main").join(reps.select("rep", "coords"), "rep").join(sets, "rep")
    own = {c: F.pmod(F.xxhash64("rep"), n).cast("int") for c, n in blocks.items()}
    columns = ["main", "block", "against", "rep", "component", "coords", "shingles", "probe"]
    base = parts.withColumn("block", own["members"]).withColumn("against", F.explode(F.sequence(F.lit(0), blocks["probes"] - 1))).withColumn("probe", F.lit(False))
    probes = parts.where("component <> main").withColumn("against", own["probes"]).withColumn("block", F.explode(F.sequence(F.lit(0), blocks["members"] - 1))).withColumn("probe", F.lit(True))
    late = base.select(columns).unionByName(probes.select(columns)).groupBy("main", "block", "against").applyInPandas(_cross_links(percent), "x long, y long")
    links = links.unionByName(late)
    if names is not None:  # rows of one id are linked
        first = names.groupBy("doc_id").agg(F.min("key").alias("y"))
        own = names.join(first, "doc_id").join(member.select(F.col("doc_id").alias("key"), F.col("rep").alias("a")), "key", "left")
        own = own.join(member.select(F.col("doc_id").alias("y"), F.col("rep").alias("b")), "y", "left")
        links = links.unionByName(own.select(F.coalesce("a", "key").alias("x"), F.coalesce("b", "y").alias("y")).where("x <> y"))
    group = components(links.toDF("a", "b"))

    rep_of = member.join(group, member["rep"] == group["node"], "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(rep_of, "doc_id", "left")
    if names is None:
        out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    else:  # rows without words too may share an id with others; keys become ids, the least key being of the least id
        ids = names.join(rep_of.select(F.col("doc_id").alias("key"), "component_id"), "key", "left").select("doc_id", F.coalesce("component_id", "key").alias("key"))
        least = ids.join(names.select("key", F.col("doc_id").alias("least")), "key").groupBy("doc_id").agg(F.min("least").alias("component_id"))
        out = out.select(F.col("doc_id").alias("key"), "n_shingles").join(names, "key").join(least, "doc_id").select("doc_id", "n_shingles", "component_id")
    none = nameless.mapInArrow(_sign, _SIGNED).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(none).select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))
