"""SimHash near-duplicates through pivot distance tables.

A text's fingerprint takes, bit by bit, the majority of the XXH64 hashes of its word shingles.  Distinct fingerprints are
linked if at most ``distance`` bits differ.  For every fingerprint a table holds its Hamming distances to reference
fingerprints (pivots), and two linked fingerprints never differ by more than ``distance`` in any coordinate:

* One base pivot and its 64 neighbours, one flipped bit each.  The differences of a neighbour's distance to the base's
  distance split into ``distance + 2`` blocks; linked fingerprints agree on all coordinates of at least two blocks.
  Pairs of blocks are the join keys, so no pair is formed that the table could discard by those coordinates.
* ``CHECKS`` further pivots: a pair whose largest coordinate difference exceeds ``distance`` is discarded.

Survivors are verified by their bits.  A key with more than ``CROWD`` distinct fingerprints is not paired: its members
meet at the points one bit away from them instead.  Two fingerprints two bits apart share such a point, and a point has
65 members at most, so a crowd of any size gives its links without forming pairs.

Defined cases: null, empty and blank texts have no words and the fingerprint 0, linked like any other; a null id is
larger than any other (a component of null ids only has a null id); repeated rows stay rows of their own; an empty table
gives an empty result; other columns are ignored, and kept by :func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faqloom.llm.common import is_small, join_counts
from faqloom.llm.components import components
from faqloom.session import materialize

SEED = 42
CROWD = 64
CHECKS = 16
#: Shingles hashed at a time: bounds the memory of a very long text.
CHUNK = 1 << 16
#: The base pivot and the step from one checking pivot to the next; any odd numbers would do.
BASE, STEP = 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15
BITS = 64


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The fingerprint of UTF-8 text as a signed 64-bit number."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, and blanks are 0x20 and 0x09-0x0D
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(islice(words, i, None) for i in range(shingle)))) if n > 1 else iter(
        [b" ".join(words)]
    )
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    while chunk := [digest(g, SEED) for g in islice(grams, CHUNK)]:
        octets = np.array(chunk, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, text_key, fp (bigint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x, shingle) for x in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(fps, pa.int64())], ["doc_id", "text_key", "fp"]
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.encode(text, "UTF-8").alias("raw")
    )
    return rows.mapInArrow(run, f"doc_id {kind}, text_key bigint, fp bigint")


def text_key(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def _signed(value: int) -> int:
    value &= (1 << BITS) - 1
    return value - (1 << BITS) if value >> (BITS - 1) else value


def pivots() -> list[int]:
    """The base, its neighbours by one bit, and the checking pivots."""
    near = [BASE ^ (1 << i) for i in range(BITS)]
    checks = [(STEP * (2 * i + 1)) ^ (STEP >> (i + 1)) for i in range(CHECKS)]
    return [_signed(p) for p in (BASE, *near, *checks)]


def distance_table(fps: DataFrame) -> DataFrame:
    """fp -> fp, d: its Hamming distances to all pivots."""
    refs = F.array(*[F.lit(p).cast("bigint") for p in pivots()])
    return fps.select("fp", F.transform(refs, lambda p: F.bit_count(F.col("fp").bitwiseXOR(p))).alias("d"))


def _agreements(distance: int) -> Column:
    """The join keys from the base pivot's neighbourhood: an array of (key number, key)."""
    blocks = distance + 2
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    sides = [  # a neighbour is nearer or farther than the base: one bit for each coordinate of the block
        F.aggregate(
            F.slice("d", edges[i] + 2, edges[i + 1] - edges[i]),
            F.lit(0).cast("bigint"),
            lambda acc, x: acc * 2 + (x < F.get("d", F.lit(0))).cast("bigint"),
        )
        for i in range(blocks)
    ]
    pairs = list(combinations(range(blocks), 2))
    return F.array(
        *[F.struct(F.lit(k).alias("no"), sides[i].alias("one"), sides[j].alias("two")) for k, (i, j) in enumerate(pairs)]
    )


def _packed() -> list[Column]:
    """The checking coordinates, eight to a bigint."""
    return [
        sum((F.shiftleft(F.get("d", F.lit(1 + BITS + at + i)).cast("bigint"), 8 * i) for i in range(1, 8)),
            F.get("d", F.lit(1 + BITS + at)).cast("bigint")).alias(f"c{at // 8}")
        for at in range(0, CHECKS, 8)
    ]


def _within(distance: int, a: str, b: str) -> Column:
    """No checking coordinate differs by more than the distance."""
    ok = F.lit(True)
    for c in range(CHECKS // 8):
        for i in range(8):
            x, y = (F.shiftrightunsigned(F.col(f"{side}.c{c}"), 8 * i).bitwiseAND(F.lit(127)) for side in (a, b))
            ok = ok & (F.abs(x - y) <= distance)
    return ok


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) whose components are those of all pairs within the distance."""
    if not 0 <= distance <= 2:
        raise ValueError("links are found for distances of 0, 1 and 2 bits")
    keys = materialize(
        distance_table(fps).select("fp", *_packed(), F.explode(_agreements(distance)).alias("k")).select(
            "fp", "c0", "c1", "k.no", "k.one", "k.two"
        ),
        "pivot-keys",
    )
    on = ["no", "one", "two"]
    sizes = keys.groupBy(*on).agg(F.count("*").alias("members")).filter("members > 1")
    shared = materialize(keys.join(sizes.hint("merge"), on), "pivot-shared")
    few = shared.filter(F.col("members") <= CROWD)
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on]
    near = few.alias("x").join(few.alias("y").hint("merge"), [*same, F.col("x.fp") < F.col("y.fp"), _within(distance, "x", "y")])
    a, b = F.col("x.fp"), F.col("y.fp")
    verified = near.filter(F.bit_count(a.bitwiseXOR(b)) <= distance).select(a.alias("a"), b.alias("b"))
    crowd = shared.filter(F.col("members") > CROWD).select("fp").distinct()
    return verified.union(_meetings(crowd, distance))


def _meetings(crowd: DataFrame, distance: int) -> DataFrame:
    """Links by the points that members have in common, a star at each point."""
    flips = [F.lit(0).cast("bigint")] + [F.lit(_signed(1 << i)).cast("bigint") for i in range(BITS)]
    points = crowd.select("fp", F.explode(F.transform(F.array(*flips), lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    own = F.max(F.when(F.col("fp") == F.col("point"), F.col("fp")))
    centre = F.min("fp") if distance == 2 else own  # one bit: only those around a member; none for no bit
    met = points.groupBy("point").agg(centre.alias("a"), F.collect_list("fp").alias("all"))  # 65 members at most
    met = met.filter(F.col("a").isNotNull() & (F.size("all") > 1) & F.lit(distance > 0))
    return met.select("a", F.explode("all").alias("b")).filter("a != b")


def groups(docs: DataFrame, shingle: int = 3, distance: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, text_key, fp, fingerprint (hex), component_id, root (the component's smallest fp)."""
    narrow = materialize(fingerprints(docs, shingle, doc_id, text), "simhash")
    per = materialize(
        narrow.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")), "simhash-distinct"
    )
    found = materialize(links(per.select("fp"), distance), "simhash-links")
    roots = materialize(components(found), "simhash-roots").withColumnRenamed("node", "fp")
    rooted = per.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # a component can be one third of all fingerprints: its smallest id is a map-side minimum, joined back by weight
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("fps"))
    classed = join_counts(rooted, materialize(ids, "simhash-ids"), "root", "fps", ["component_id"])
    out = join_counts(narrow, materialize(classed, "simhash-classes"), "fp", "rows", ["component_id", "root"])
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return out.select("doc_id", "text_key", "fp", hexed.alias("fingerprint"), "component_id", "root")


def deduplicate(
    docs: DataFrame, shingle: int = 3, distance: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns.

    Documents to drop are joined away by (id, text), so kept texts move only if that list is too large to broadcast.
    """
    rows = materialize(groups(docs, shingle, distance, doc_id, text), "simhash-groups")
    members = rows.groupBy("root", "component_id", "doc_id", "text_key").agg(F.count("*").alias("copies"))
    # several rows with the component's own id: the smallest text key stays
    own = members.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = own.groupBy("root").agg(F.min("text_key").alias("kept_key"), F.min("doc_id").alias("kept_id"))
    first = materialize(first.select("kept_id", "kept_key"), "simhash-first")
    # the kept row's key differs from the component's first only where rows repeat an id, so this join is by (id, key)
    mine = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key"))
    tagged = members.join(first, mine, "left").withColumn("kept", F.col("kept_key").isNotNull())
    tagged = tagged.filter(~F.col("kept") | (F.col("copies") > 1))
    gone = materialize(
        tagged.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "kept"), "simhash-gone"
    )
    packed = docs.select(
        F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_doc"), text_key(F.col(text)).alias("_text_key")
    )
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))
    side = F.broadcast(gone) if is_small(gone) else gone.hint("merge")
    kept = packed.join(side.drop("kept"), same, "left_anti").select("_row.*")
    twice = gone.filter("kept").drop("kept")
    if not twice.take(1):
        return kept
    side = F.broadcast(twice) if is_small(twice) else twice.hint("merge")
    again = packed.join(side, same, "left_semi")  # rows that repeat a kept row: one of them
    once = again.groupBy("_doc", "_text_key").agg(F.first("_row").alias("_row")).select("_row.*")
    return kept.unionByName(once)
