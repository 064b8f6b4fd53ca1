"""Encoded corpora and language-model batches.

A batch lane is never built by walking the corpus: every line knows its global place (two-phase running total), cuts
itself at lane and window borders, and one grouping by (batch, lane) puts the cuts of a window together.  A group holds
one window and nothing more.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faqloom.functions.draws import unit_draw
from faqloom.functions.text import word_token_array
from faqloom.operators.lookup import fits_broadcast, lookup_lists
from faqloom.operators.ordering import hash_order, quantile_buckets, running_total
from faqloom.session import bucket_count, materialize, task_width


def encode_lines(
    lines: DataFrame, vocab: DataFrame, key: Sequence[str], unknown: str = "error", unknown_id: int | None = None,
    repeated: bool = False, **markers
) -> DataFrame:
    """Each line as its ids: ``key``, ``ids``.  ``markers`` go to the word tokenizer; with ``repeated``, lines of equal keys
    are merged."""
    listed = lines.select(*key, word_token_array(F.col("line"), **markers).alias("tokens"))
    if not fits_broadcast(vocab.select("token", "id")):
        listed = materialize(listed, "line-tokens", "zstd")
    coded = encode_lists(listed, vocab, unknown, unknown_id)
    return merge_lists(coded, "ids", key) if repeated else coded


def encode_lists(
    listed: DataFrame, vocab: DataFrame, unknown: str = "error", unknown_id: int | None = None
) -> DataFrame:
    """Rows with a list of ``tokens`` as rows with ``ids``; a line without tokens is left out.  The rule for unknown tokens is
    that of :func:`faqloom.operators.vocab.encode`.

    Whole lists meet the vocabulary, so that no token rows are sorted back into lines.
    """
    if unknown == "token" and unknown_id is None:
        raise ValueError("no unknown token in the vocabulary")
    held = listed.filter(F.size("tokens") > 0)
    if unknown in ("zero", "token"):
        return lookup_lists(held, "tokens", vocab, "token", "id", "ids", 0 if unknown == "zero" else unknown_id)
    coded = lookup_lists(held, "tokens", vocab, "token", "id", "_ids")
    missing = F.raise_error(F.lit("token not in the vocabulary")).cast("int")
    return coded.withColumn("ids", F.transform("_ids", lambda i: F.coalesce(i, missing))).drop("_ids")


def decode_lists(coded: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows with a list of ``ids`` as rows with ``tokens``; an id outside the vocabulary is an error."""
    named = lookup_lists(coded, "ids", vocab, "id", "token", "_tokens")
    missing = F.raise_error(F.lit("id out of vocabulary range")).cast("string")
    return named.withColumn("tokens", F.transform("_tokens", lambda t: F.coalesce(t, missing))).drop("_tokens")


def merge_lists(rows: DataFrame, column: str, key: Sequence[str]) -> DataFrame:
    """One row per ``key``: lists of equal keys are merged by place, then by value."""
    placed = F.flatten(F.transform("_l", lambda l: F.transform(l, lambda v, i: F.struct(i.alias("i"), v.alias("v")))))
    merged = F.transform(F.sort_array(placed), lambda s: s["v"])
    lists = rows.groupBy(*key).agg(F.collect_list(column).alias("_l"))
    return lists.select(*key, F.when(F.size("_l") == 1, F.get("_l", F.lit(0))).otherwise(merged).alias(column))


def place_lines(corpus: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Flat order of an encoded corpus: ``at`` = tokens ahead of the line in its group, ``total`` = tokens of the group."""
    width = task_width(corpus)
    cut = quantile_buckets(corpus, "doc_id", "_b", max(bucket_count(corpus.sparkSession), width))
    return running_total(
        cut, F.size("ids"), ["doc_id", "line_no"], ["_b"], "at", group=group, group_total="total", width=width
    ).drop("_b")


def _cut_lanes(placed: DataFrame, bsz: int, group: Sequence[str]) -> DataFrame:
    """Pieces of lines per lane: ``lane``, ``a`` and ``b`` (steps in the lane), ``part`` (ids), ``n_step``.
    The remainder that does not fill all lanes evenly is left out."""
    rows = placed.withColumn("n_step", F.expr(f"total div {bsz}")).filter("n_step >= 2 AND size(ids) > 0")
    lanes = "sequence(at div n_step, least((at + size(ids) - 1) div n_step, CAST({} AS BIGINT)))".format(bsz - 1)
    rows = rows.filter(f"at < n_step * {bsz}").withColumn("lane", F.explode(F.expr(lanes)))
    rows = rows.withColumns({
        "a": F.expr("greatest(at, lane * n_step) - lane * n_step"),
        "b": F.expr("least(at + size(ids), (lane + 1) * n_step) - lane * n_step"),
    })
    part = F.expr("slice(ids, CAST(lane * n_step + a - at + 1 AS INT), CAST(b - a AS INT))")
    return rows.select(*group, "lane", "n_step", "a", "b", part.alias("part"))


def _join_cuts(cuts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Put the cuts of each window together; ``seq_len`` new steps, the rest of the input is retained context."""
    ordered = F.sort_array(F.collect_list(F.struct("c", "part")))
    whole = cuts.groupBy(*group, "batch", "lane").agg(
        F.flatten(F.transform(ordered, lambda s: s["part"])).alias("seq"), F.max("seq_len").alias("seq_len")
    )
    return whole.select(
        *group, "batch", F.col("lane").cast("int").alias("lane"),
        F.slice("seq", F.lit(1), F.size("seq") - 1).alias("input"),
        F.slice("seq", F.size("seq") - F.col("seq_len") + 1, F.col("seq_len")).alias("target"),
    )


_CUT = "slice(part, CAST(c - a + 1 AS INT), CAST(d - c AS INT))"


def ordered_batches(
    placed: DataFrame, bsz: int, bptt: int, ext_len: int = 0, group: Sequence[str] = ()
) -> DataFrame:
    """Windows of ``bptt`` steps in ``bsz`` parallel lanes of the flat corpus: batch, lane, input, target.
    The target is the next token in the lane; ``ext_len`` earlier tokens come ahead of the input."""
    cuts = _cut_lanes(placed, bsz, group)
    windows = f"sequence(greatest(a - 1, 0) div {bptt}, least((b - 1 + {ext_len}) div {bptt}, (n_step - 2) div {bptt}))"
    cuts = cuts.filter(f"greatest(a - 1, 0) div {bptt} <= (n_step - 2) div {bptt}")
    cuts = cuts.withColumn("batch", F.explode(F.expr(windows)))
    cuts = cuts.withColumns({
        "c": F.expr(f"greatest(a, batch * {bptt} - {ext_len})"),
        "d": F.expr(f"least(b, batch * {bptt} + {bptt} + 1, n_step)"),
        "seq_len": F.expr(f"CAST(least({bptt}, n_step - 1 - batch * {bptt}) AS INT)"),
    }).filter("c < d")
    return _join_cuts(cuts.withColumn("part", F.expr(_CUT)), group)


def window_lengths(
    spark, n_step: int, bptt: int, seed: int, std: float = 5, min_len: int = 5, max_deviation: int = 3
) -> DataFrame:
    """Random windows over ``n_step`` steps: batch, start, seq_len.

    Lengths scatter normally around ``bptt`` (one time in twenty around half of it), between ``min_len`` and
    ``bptt + max_deviation * std``.  Draws are independent, so starts are a running total.
    """
    draws = spark.range(n_step // min_len + 2).withColumnRenamed("id", "batch")

    def u(k: int) -> Column:
        return unit_draw(seed, F.col("batch"), F.lit(k))

    base = F.when(u(0) < 0.95, F.lit(float(bptt))).otherwise(F.lit(bptt / 2.0))
    normal = F.sqrt(-2.0 * F.ln(1.0 - u(1))) * F.cos(F.lit(2.0 * 3.141592653589793) * u(2))
    drawn = (base + normal * std).cast("bigint")
    length = F.least(F.lit(int(bptt + max_deviation * std)), F.greatest(F.lit(min_len), drawn)).cast("bigint")
    rows = draws.withColumn("_len", length).withColumn("_b", F.expr("batch div 65536"))
    rows = running_total(rows, F.col("_len"), ["batch"], ["_b"], "start")
    rows = rows.filter((F.col("batch") == 0) | (F.col("start") < n_step - 2))
    seq_len = F.least(F.col("_len"), F.lit(n_step - 1) - F.col("start")).cast("int")
    return rows.select("batch", "start", seq_len.alias("seq_len"))


def varlen_batches(
    placed: DataFrame, bsz: int, bptt: int, seed: int, ext_len: int = 0, std: float = 5, min_len: int = 5,
    max_deviation: int = 3,
) -> DataFrame:
    """Ordered batches with random window lengths.  Line cuts meet their windows by an equi-join on step bins."""
    row = placed.select("total").first()
    if row is None or row[0] // bsz < 2:
        return ordered_batches(placed, bsz, bptt)
    windows = window_lengths(placed.sparkSession, row[0] // bsz, bptt, seed, std, min_len, max_deviation)
    windows = windows.withColumns({
        "lo": F.expr(f"greatest(start - {ext_len}, 0)"), "hi": F.expr("start + seq_len + 1")})

    def bins(df: DataFrame, first: str, past: str, name: str) -> DataFrame:
        return df.withColumn(name, F.expr(f"{first} div {bptt}")).withColumn(
            "bin", F.explode(F.expr(f"sequence({name}, ({past} - 1) div {bptt})")))

    cuts = bins(_cut_lanes(placed, bsz, ()), "a", "b", "bin_a")
    met = cuts.join(bins(windows, "lo", "hi", "bin_w"), "bin").filter("bin = greatest(bin_a, bin_w)")
    met = met.withColumns({"c": F.expr("greatest(a, lo)"), "d": F.expr("least(b, hi)")}).filter("c < d")
    return _join_cuts(met.withColumn("part", F.expr(_CUT)), ())


def packed_batches(
    sentences: DataFrame,
    bsz: int,
    bptt: int,
    ext_len: int = 0,
    group: Sequence[str] = (),
    shuffle_seed: int | None = None,
) -> DataFrame:
    """Lanes filled from sentences with (token, next token) pairs that never cross a sentence.

    Sentences of one token give no pair.  The pairs in corpus order are cut into ``bsz`` lanes of as many whole windows
    as all lanes can have, so at most ``bsz * bptt - 1`` pairs of a group are left over; a sentence may go on in the next
    lane.  ``group`` packs each file on its own.
    """
    width = task_width(sentences)
    rows = sentences.filter(F.size("ids") > 1)
    if shuffle_seed is None:
        rows = quantile_buckets(rows, "doc_id", "_b", max(bucket_count(rows.sparkSession), width))
        order, bucket = ["doc_id", "line_no"], ["_b"]
    else:
        rows = hash_order(rows, ["doc_id", "line_no"], shuffle_seed)
        order, bucket = ["_h", "doc_id", "line_no"], ["_b"]
    rows = running_total(rows, F.size("ids") - 1, order, bucket, "at", group=group, group_total="total", width=width)
    rows = rows.withColumn("n_pair", F.expr(f"total div {bsz * bptt} * {bptt}")).filter(f"n_pair > 0 AND at < n_pair * {bsz}")
    lanes = f"sequence(at div n_pair, least((at + size(ids) - 2) div n_pair, CAST({bsz - 1} AS BIGINT)))"
    rows = rows.withColumn("lane", F.explode(F.expr(lanes))).withColumns({
        "a": F.expr("greatest(at, lane * n_pair) - lane * n_pair"),
        "b": F.expr("least(at + size(ids) - 1, (lane + 1) * n_pair) - lane * n_pair"),
        "skip": F.expr("greatest(lane * n_pair - at, 0)"),
    })
    batches = f"sequence(a div {bptt}, least((b - 1 + {ext_len}) div {bptt}, n_pair div {bptt} - 1))"
    rows = rows.withColumn("batch", F.explode(F.expr(batches))).withColumns({
        "c": F.expr(f"greatest(a, batch * {bptt} - {ext_len})"),
        "d": F.expr(f"least(b, (batch + 1) * {bptt})"),
    }).filter("c < d")
    cuts = rows.select(
        *group, "batch", "lane", "c",
        F.expr("slice(ids, CAST(skip + c - a + 1 AS INT), CAST(d - c AS INT))").alias("now"),
        F.expr("slice(ids, CAST(skip + c - a + 2 AS INT), CAST(d - c AS INT))").alias("next"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("c", "now", "next")))
    whole = cuts.groupBy(*group, "batch", "lane").agg(
        F.flatten(F.transform(ordered, lambda s: s["now"])).alias("input"),
        F.flatten(F.transform(ordered, lambda s: s["next"])).alias("next"),
    )
    return whole.select(
        *group, "batch", F.col("lane").cast("int").alias("lane"), "input",
        F.slice("next", F.size("next") - bptt + 1, F.lit(bptt)).alias("target"),
    )


@dataclass(frozen=True)
class CorpusFamily:
    """How a corpus family is counted, marked and batched."""

    counted: tuple[str, ...]
    specials: tuple[str, ...]
    lower: bool
    markers: dict
    train_by_file: bool = False
    packed: bool = False


# The corpus families and their treatment.
_ALL = ("train", "valid", "test")
FAMILIES = {
    "ptb": CorpusFamily(_ALL, ("<eos>",), True, {"add_eos": True}),
    "wt2": CorpusFamily(_ALL, ("<eos>",), False, {"add_eos": True}),
    "wt103": CorpusFamily(("train",), ("<eos>",), False, {"add_eos": True}),
    "enwik8": CorpusFamily(_ALL, (), False, {}),
    "text8": CorpusFamily(_ALL, (), False, {}),
    "lm1b": CorpusFamily((), (), False, {"add_double_eos": True}, train_by_file=True, packed=True),
}


def family_batches(
    family: str, encoded: DataFrame, split: str, bsz: int, bptt: int, ext_len: int = 0, shuffle_seed: int = 42
) -> DataFrame:
    """Batches of one split of an encoded corpus (``split``, ``source`` as file, doc_id, line_no, ids)."""
    rules = FAMILIES[family]
    rows = encoded.filter(F.col("split") == split)
    if not rules.packed:
        return ordered_batches(place_lines(rows), bsz, bptt, ext_len)
    if rules.train_by_file and split == "train":
        return packed_batches(rows, bsz, bptt, ext_len, ["source"], shuffle_seed)
    return packed_batches(rows, bsz, bptt, ext_len)
