"""Simulated structural evidence: universes, seeded sampling, corruption, checks, eligibility, constraints.

Sampling ranks items by a SHA-256 of (version, RNA, channel, density, seed, item), so every engine and every retry
picks the same items. Ranks are running counts inside hash-prefix buckets: a huge RNA is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pairscope.functions.graph import mutual_best
from pairscope.functions.running import COORDINATE_BUCKET, coordinate_bucket, running_totals
from pairscope.operators.agreement import CANONICAL
from pairscope.operators.errors import endpoints
from pairscope.session import cut_lineage

VERSION = "evidence_v1"
PAIR, UNPAIRED = "positive_pair", "unpaired"
SEPARATOR = chr(31)
MINIMUM_LOOP = 3
CELL = 64  # positions that share a cell when crossings are looked up
MANIFEST = ["rna_id", "channel", "density", "seed"]


def evidence_universe(truth: DataFrame, rnas: DataFrame) -> DataFrame:
    """(rna_id, channel, i, j): the true pairs, and the positions unpaired in truth (j null)."""
    positions = rnas.select("rna_id", F.explode(F.sequence(F.lit(0), F.col("sequence_length") - 1)).alias("i"))
    paired = truth.select("rna_id", F.explode(F.array("i", "j")).alias("i"))
    return truth.select("rna_id", F.lit(PAIR).alias("channel"), "i", "j").unionByName(
        positions.join(paired, ["rna_id", "i"], "left_anti").select(
            "rna_id", F.lit(UNPAIRED).alias("channel"), "i", F.lit(None).cast("int").alias("j")))


def rounded_count(size: Column, percent: Column, minimum_one: bool) -> Column:
    """Half-up percentage of a size, at least one item of a non-empty universe when asked."""
    count = F.floor((size * percent + 50) / 100)
    if minimum_one:
        count = F.when((count == 0) & (percent > 0) & (size > 0), 1).otherwise(count)
    return F.least(size, count).cast("int")


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, *[p.cast("string") for p in parts]), 256)


def _prefix_bucket(size: Column, digest: str) -> Column:
    """Enough leading hex digits of the digest to leave about 4096 items per bucket; none for small universes."""
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, size / F.lit(COORDINATE_BUCKET)))).cast("int")
    return F.substring(F.col(digest), F.lit(1), digits)


def manifests(universe: DataFrame, rnas: DataFrame, densities: Sequence[int], seeds: Sequence[int]) -> DataFrame:
    """One row per (RNA, channel, density, seed) with the universe size and how many items are selected."""
    sizes = universe.groupBy("rna_id", "channel").agg(F.count("*").alias("universe_size"))
    channels = rnas.select("rna_id", F.explode(F.array(F.lit(PAIR), F.lit(UNPAIRED))).alias("channel"))
    grid = [F.struct(F.lit(d).alias("density"), F.lit(s).alias("seed")) for d in densities for s in seeds]
    size, density = F.col("universe_size"), F.col("density")
    return (
        channels.join(sizes, ["rna_id", "channel"], "left").fillna(0, ["universe_size"])
        .withColumn("_g", F.explode(F.array(*grid))).select("rna_id", "channel", "universe_size", "_g.density", "_g.seed")
        .withColumn("selected", rounded_count(size, density, True))
        .withColumn("minimum_one", ((density > 0) & (size > 0) & (F.floor((size * density + 50) / 100) == 0)).cast("int"))
        .withColumn("manifest_id", F.concat_ws("__", F.lit(VERSION), *MANIFEST))
    )


def sample_evidence(universe: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    """Selected items per manifest: the items with the smallest digests."""
    wanted = manifest_rows.where("selected > 0").select(*MANIFEST, "manifest_id", "universe_size", "selected")
    rows = universe.join(wanted, ["rna_id", "channel"]).withColumn(
        "digest", _hash(F.lit(VERSION), *[F.col(c) for c in MANIFEST], F.col("i"), F.coalesce("j", F.lit(-1))))
    ranked = running_totals(
        rows.withColumn("_bucket", _prefix_bucket(F.col("universe_size"), "digest")), ["manifest_id"], ["digest"], {"rank": F.lit(1)})
    return ranked.where("rank <= selected").select(*MANIFEST, "manifest_id", "i", "j")


def with_item_index(items: DataFrame) -> DataFrame:
    """Zero-based position of each item in coordinate order within its manifest."""
    ranked = running_totals(items.withColumn("_bucket", coordinate_bucket()), ["manifest_id"], ["i"], {"_r": F.lit(1)})
    return ranked.withColumn("item_index", F.col("_r") - 1).drop("_r", "_bucket")


def corrupt_unpaired(items: DataFrame, truth: DataFrame, noise_percent: int) -> DataFrame:
    """Replace a rounded share of the unpaired items by paired positions, hash rank to hash rank.

    Items are ranked by digest for choice, paired positions by digest for supply; equal ranks join. Clean items are
    unpaired positions, so a paired position is never already in use.
    """
    base = items.where(F.col("channel") == UNPAIRED)
    sizes = base.groupBy("manifest_id").agg(F.count("*").alias("size"))
    tagged = base.join(sizes, "manifest_id").withColumns({
        "digest": _hash(F.col("manifest_id"), F.lit(noise_percent), F.col("i"), F.lit("choice")),
        "wanted": rounded_count(F.col("size"), F.lit(noise_percent), False)})
    chosen = running_totals(
        tagged.withColumn("_bucket", _prefix_bucket(F.col("size"), "digest")), ["manifest_id"], ["digest"], {"rank": F.lit(1)}
    ).withColumn("requested", F.col("rank") <= F.col("wanted"))
    demand = chosen.where("requested").select("manifest_id", "rna_id", "wanted").distinct()
    paired = truth.select("rna_id", F.explode(F.array("i", "j")).alias("p")).distinct()
    per_rna = paired.groupBy("rna_id").agg(F.count("*").alias("supply_size"))
    supply = demand.join(paired, "rna_id").join(per_rna, "rna_id").withColumn(
        "digest", _hash(F.col("manifest_id"), F.lit(noise_percent), F.col("p"), F.lit("supply")))
    supply = running_totals(
        supply.withColumn("_bucket", _prefix_bucket(F.col("supply_size"), "digest")), ["manifest_id"], ["digest"], {"rank": F.lit(1)}
    ).where("rank <= wanted").select("manifest_id", "rank", "p")
    keys = F.when(F.col("requested"), F.col("rank"))
    return chosen.withColumn("rank", keys).join(supply, ["manifest_id", "rank"], "left").select(
        *MANIFEST, "manifest_id", F.col("i").alias("clean_i"), F.col("j").alias("clean_j"),
        F.when(~F.col("requested"), F.col("i")).otherwise(F.col("p")).alias("i"), F.lit(None).cast("int").alias("j"),
        F.when(~F.col("requested"), "CLEAN").when(F.col("p").isNull(), "CORRUPTION_UNAVAILABLE").otherwise("CORRUPTED").alias("status"))


def corrupt_pairs(items: DataFrame, truth: DataFrame, rnas: DataFrame, noise_levels: Sequence[int]) -> DataFrame:
    """Replace a rounded share of the pair items at each noise level: one end stays, the other moves.

    The new pair is canonical and not true, and its moved end is used by no other delivered item. Which items change and
    which end stays are hash choices. Moves are the edges item - position; taken greedily in hash order they are
    rounds of mutually best edges, so an item is CORRUPTION_UNAVAILABLE only where no allowed position is left.
    Columns: noise, manifest keys, manifest_id, clean_i, clean_j, i, j, status.
    """
    case = ["manifest_id", "noise"]
    base = items.where(F.col("channel") == PAIR).withColumn("noise", F.explode(F.array(*[F.lit(n) for n in noise_levels])))
    sizes = base.groupBy(*case).agg(F.count("*").alias("size"))
    tagged = base.join(sizes, case).withColumns({
        "digest": _hash(F.col("manifest_id"), F.col("noise"), F.col("i"), F.lit("choice")),
        "wanted": rounded_count(F.col("size"), F.col("noise"), False)})
    ranked = running_totals(
        tagged.withColumn("_bucket", _prefix_bucket(F.col("size"), "digest")), case, ["digest"], {"rank": F.lit(1)})
    upper = F.conv(F.substring(_hash(F.col("manifest_id"), F.col("noise"), F.col("i"), F.lit("end")), 1, 1), 16, 10).cast("int") % 2 == 1
    chosen = cut_lineage(ranked.withColumn("requested", F.col("rank") <= F.col("wanted")).withColumn(
        "kept", F.when(F.col("requested"), F.when(upper, F.col("j")).otherwise(F.col("i")))).select(*MANIFEST, *case, "i", "j", "requested", "kept"))
    taken = chosen.select(*case, F.explode(F.when(F.col("requested"), F.array("kept")).otherwise(F.array("i", "j"))).alias("p")).distinct()
    letters = rnas.select("rna_id", F.posexplode(F.split("sequence", "")).alias("p", "letter")).where("letter <> ''")
    moves = (
        chosen.where("requested").select("rna_id", *case, F.col("i").alias("item"), "kept")
        .join(letters.select("rna_id", F.col("p").alias("kept"), F.col("letter").alias("a")), ["rna_id", "kept"])
        .join(letters.select("rna_id", "p", F.col("letter").alias("b")), "rna_id").where("p <> kept")
        .join(taken, [*case, "p"], "left_anti")
        .withColumns({"di": F.least("kept", "p"), "dj": F.greatest("kept", "p")})
        .where(F.when(F.col("p") > F.col("kept"), F.concat("a", "b")).otherwise(F.concat("b", "a")).isin(*CANONICAL))
        .join(truth.select("rna_id", F.col("i").alias("di"), F.col("j").alias("dj")), ["rna_id", "di", "dj"], "left_anti")
    )
    order = _hash(F.col("manifest_id"), F.col("noise"), F.col("item"), F.col("p"), F.lit("move"))
    made = mutual_best(moves.select(*case, "item", "p", "di", "dj"), [*case, "item"], [*case, "p"], [order.alias("o")])
    out = chosen.join(made.withColumnRenamed("item", "i"), [*case, "i"], "left")
    keep = ~F.col("requested")
    return out.select(
        "noise", *MANIFEST, "manifest_id", F.col("i").alias("clean_i"), F.col("j").alias("clean_j"),
        F.when(keep, F.col("i")).otherwise(F.col("di")).alias("i"), F.when(keep, F.col("j")).otherwise(F.col("dj")).alias("j"),
        F.when(keep, "CLEAN").when(F.col("di").isNull(), "CORRUPTION_UNAVAILABLE").otherwise("CORRUPTED").alias("status"))


def validate_evidence(
        items: DataFrame, manifest_rows: DataFrame, universe: DataFrame, truth: DataFrame, keys: Sequence[str] = ("manifest_id",)) -> DataFrame:
    """Findings per manifest: counts, membership, uniqueness, one partner, status rules. Empty when all is well.

    ``items``: keys, rna_id, channel, clean_i, clean_j, i, j, status; ``manifest_rows``: keys, selected. The keys are
    those of a delivery: the manifest, and the noise level where there are several.
    """
    keys = list(keys)
    key = F.concat_ws("-", "clean_i", "clean_j")
    inside = universe.select("rna_id", "channel", F.concat_ws("-", "i", "j").alias("_k"), F.lit(1).alias("_in"))
    known = items.withColumn("_k", key).join(inside, ["rna_id", "channel", "_k"], "left")
    is_true = truth.select("rna_id", "i", "j", F.lit(1).alias("_true"))
    known = known.join(is_true, ["rna_id", "i", "j"], "left")
    ends = F.array_compact(F.array("i", "j"))
    held = items.select(*keys, F.explode(ends).alias("e")).groupBy(*keys, "e").agg(F.count("*").alias("n"))
    shared = held.groupBy(*keys).agg(F.max("n").alias("most"))
    moved = F.col("status") == "CORRUPTED"
    # a corrupted pair keeps exactly one end of its clean pair
    held_ends = (F.col("i").isin(F.col("clean_i"), F.col("clean_j"))).cast("int") + (F.col("j").isin(F.col("clean_i"), F.col("clean_j"))).cast("int")
    stats = known.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("_in").isNull()).alias("outside"),
        F.count_if((F.col("status") == "CLEAN") & ~(F.col("i").eqNullSafe(F.col("clean_i")) & F.col("j").eqNullSafe(F.col("clean_j")))).alias("modified"),
        F.count_if(moved & F.col("_true").isNotNull()).alias("true_pair"), F.count_if(moved & F.col("i").isNull()).alias("empty"),
        F.count_if(moved & (F.col("channel") == PAIR) & (held_ends != 1)).alias("loose"),
        F.count_if((F.col("status") == "CORRUPTION_UNAVAILABLE") & F.col("i").isNotNull()).alias("delivered"))
    rows = manifest_rows.select(*keys, "selected").join(stats, keys, "left").join(shared, keys, "left")
    checks = {
        "selected_count": F.coalesce("n", F.lit(0)) != F.col("selected"), "outside_universe": F.col("outside") > 0,
        "clean_item_modified": F.col("modified") > 0, "corrupted_is_true": F.col("true_pair") > 0,
        "endpoint_not_preserved": F.col("loose") > 0, "corrupted_without_value": F.col("empty") > 0, "unavailable_delivers": F.col("delivered") > 0,
        "position_used_twice": F.col("most") > 1,
    }
    return rows.select(*keys, F.explode(F.array_compact(F.array(*[
        F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))).alias("finding"))


def payload_hash(manifest_rows: DataFrame, items: DataFrame) -> DataFrame:
    """SHA-256 of the key-sorted JSON of a manifest and its ordered items; null fields are kept."""
    packed = items.groupBy("manifest_id").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("items"))
    rows = manifest_rows.join(packed, "manifest_id", "left").withColumn(
        "items", F.coalesce("items", F.expr("cast(array() AS array<struct<i: int, j: int>>)")))
    return payload_digest(rows)


def payload_digest(rows: DataFrame) -> DataFrame:
    """SHA-256 of the JSON of manifest rows that hold their ordered ``items``."""
    names = sorted(["channel", "density", "items", "manifest_id", "rna_id", "seed", "selected", "universe_size"])
    text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return rows.select("manifest_id", F.sha2(text, 256).alias("payload_sha256"))


def evidence_counts(manifest_rows: DataFrame) -> DataFrame:
    return manifest_rows.groupBy("channel", "density", "seed").agg(
        F.count("*").alias("rnas"), F.sum("selected").alias("items"), F.avg("selected").alias("mean_items"),
        F.min("selected").alias("min_items"), F.max("selected").alias("max_items"), F.sum("minimum_one").alias("minimum_one"),
        F.count_if(F.col("selected") == 0).alias("zero_items"), F.count_if(F.col("universe_size") == 0).alias("zero_universe"))


def crossing_structures(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of structures with a crossing, in linear work.

    Read every left end as an opening and every right end as a closing symbol: the structure is free of crossings
    exactly when the one nested matching of those symbols is its own pairs. So a crossing shows as a closing symbol whose
    nearest unmatched opening symbol is not its partner. That reading needs one partner per position; structures that
    share a position are compared cell by cell.
    """
    keys = list(keys)
    every = endpoints(pairs, keys, "pos", "partner")
    shared = every.groupBy(*keys, "pos").agg(F.count("*").alias("n")).where("n > 1").select(*keys).distinct()
    slow = _cell_crossings(pairs.select(*keys, "i", "j").join(shared, keys, "left_semi"), keys, CELL).select(*keys)
    ends = every.join(shared, keys, "left_anti").withColumn("step", F.when(F.col("pos") < F.col("partner"), 1).otherwise(-1))
    deep = running_totals(ends.withColumn("_bucket", coordinate_bucket("pos")), keys, ["pos"], {"depth": "step"})
    level = F.when(F.col("step") == 1, F.col("depth")).otherwise(F.col("depth") + 1)
    from pyspark.sql import Window
    before = F.lag("pos").over(Window.partitionBy(*keys, "level").orderBy("pos"))
    return (
        deep.withColumn("level", level).withColumn("before", before)
        .where("step = -1 AND before <> partner").select(*keys).unionByName(slow).distinct()
    )


def _cell_crossings(pairs: DataFrame, keys: list[str], width: int) -> DataFrame:
    outer = pairs.withColumn("cell", F.explode(F.sequence(F.floor(F.col("i") / width), F.floor(F.col("j") / width))))
    inner = pairs.select(*keys, F.col("i").alias("k"), F.col("j").alias("l"), F.floor(F.col("i") / width).alias("cell"))
    return outer.join(inner, keys + ["cell"]).where("i < k AND k < j AND j < l").select(*keys, "i", "j", "k", "l")


def crossing_pairs(pairs: DataFrame, keys: Sequence[str], width: int = CELL) -> DataFrame:
    """Every ordered crossing ``i < k < j < l``.

    Only structures that hold a crossing enter the join. A pair is looked up in the coordinate cells it spans by the
    left end ``k`` of the other pair, so a structure is compared cell by cell, not all against all.
    """
    keys = list(keys)
    tangled = pairs.select(*keys, "i", "j").join(crossing_structures(pairs, keys), keys, "left_semi")
    return _cell_crossings(tangled, keys, width)


def minimum_loop(pairs: DataFrame) -> DataFrame:
    """Pairs that enclose fewer than three positions."""
    return pairs.where(F.col("j") - F.col("i") - 1 < MINIMUM_LOOP)


def manifest_eligibility(items: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    pairs = items.where(F.col("channel") == PAIR)
    short = pairs.groupBy("manifest_id").agg(
        F.max((F.col("j") - F.col("i") - 1 < MINIMUM_LOOP).cast("int")).alias("loop_flag"), F.min(F.col("j") - F.col("i")).alias("min_separation"))
    crossing = crossing_structures(pairs, ["manifest_id"]).withColumn("crossing_flag", F.lit(1))
    rows = manifest_rows.join(short, "manifest_id", "left").join(crossing, "manifest_id", "left").fillna(0, ["loop_flag", "crossing_flag"])
    return with_eligibility(rows)


def with_eligibility(rows: DataFrame) -> DataFrame:
    """One word for the two flags."""
    both, c, m = F.col("crossing_flag") + F.col("loop_flag"), F.col("crossing_flag") == 1, F.col("loop_flag") == 1
    return rows.withColumn("eligibility", F.when(both == 2, "MULTIPLE").when(c, "CROSSING").when(m, "MINIMUM_LOOP").otherwise("ELIGIBLE"))


def eligibility_coverage(eligible: DataFrame) -> DataFrame:
    """Manifests and eligible manifests pooled and by channel, density and seed, with the RNAs they cover."""
    ok = F.col("eligibility") == "ELIGIBLE"
    dims = ["channel", "density", "seed"]
    per_rna = eligible.groupBy("rna_id", *dims).agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"))
    level = F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in dims], F.lit("pooled"))
    value = F.coalesce(*[F.when(F.grouping(d) == 0, F.col(d).cast("string")) for d in dims], F.lit("all"))
    by_level = per_rna.groupingSets([[F.col("rna_id")]] + [[F.col("rna_id"), F.col(d)] for d in dims], "rna_id", *dims).agg(
        level.alias("level"), value.alias("value"), F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    return by_level.groupBy("level", "value").agg(
        F.sum("n").alias("manifests"), F.sum("ok").alias("eligible"), F.count("*").alias("rnas"),
        F.count_if(F.col("ok") > 0).alias("eligible_rnas"), F.count_if(F.col("ok") == 0).alias("zero_coverage_rnas"))


def constraint_conflicts(pairs: DataFrame, unpaired: DataFrame, lengths: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(constraint text per satisfiable set, one code per conflicting set).

    ``pairs`` keys, i, j; ``unpaired`` keys, position; ``lengths`` keys, sequence_length.
    """
    keys = list(keys)
    uses = pairs.select(*keys, F.explode(F.array("i", "j")).alias("p"), F.lit(1).alias("paired"), F.lit(0).alias("free")).unionByName(
        unpaired.select(*keys, F.col("position").alias("p"), F.lit(0).alias("paired"), F.lit(1).alias("free")))
    per_position = uses.groupBy(*keys, "p").agg(F.sum("paired").alias("paired"), F.sum("free").alias("free")).join(
        lengths.select(*keys, "sequence_length"), keys)
    unsat = per_position.where("paired > 1 OR free > 1 OR (paired > 0 AND free > 0) OR p < 0 OR p >= sequence_length").select(*keys).distinct()
    # read three times
    faults = cut_lineage(
        unsat.withColumn("rank", F.lit(0)).withColumn("code", F.lit("UNSATISFIABLE"))
        .unionByName(crossing_structures(pairs, keys).withColumn("rank", F.lit(1)).withColumn("code", F.lit("UNSUPPORTED_CROSSING")))
        .unionByName(minimum_loop(pairs).select(*keys).distinct().withColumn("rank", F.lit(2)).withColumn("code", F.lit("UNSUPPORTED_MINIMUM_LOOP")))
        .groupBy(*keys).agg(F.min_by("code", "rank").alias("code"))
    )
    marks = pairs.select(*keys, F.col("i").alias("p"), F.lit("(").alias("c")).unionByName(
        pairs.select(*keys, F.col("j").alias("p"), F.lit(")").alias("c"))).unionByName(
        unpaired.select(*keys, F.col("position").alias("p"), F.lit("x").alias("c")))
    clean = lengths.join(faults, keys, "left_anti")
    packed = marks.join(faults, keys, "left_anti").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("p", "c"))).alias("m"))
    text = F.expr("array_join(transform(sequence(0, sequence_length - 1), x -> coalesce(m[x], '.')), '')")
    return clean.join(packed, keys, "left").withColumn("text", text).select(*keys, "text"), faults


def constraint_satisfaction(refolded: DataFrame, rnas: DataFrame, forced: DataFrame, unpaired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Findings on a given refolded structure: non-canonical or crossing output, missing pairs, positions still paired."""
    keys = list(keys)
    seq = refolded.join(rnas.select("rna_id", "sequence"), "rna_id")
    kind = F.concat(F.substring(F.col("sequence"), F.col("i") + 1, F.lit(1)), F.substring(F.col("sequence"), F.col("j") + 1, F.lit(1)))
    parts = [
        (seq.where(~kind.isin(*CANONICAL)), "ILLEGAL_PAIR"),
        (forced.join(refolded, [*keys, "i", "j"], "left_anti"), "MISSING_FORCED_PAIR"),
        (unpaired.join(refolded.select(*keys, F.explode(F.array("i", "j")).alias("position")), [*keys, "position"], "left_semi"), "PAIRED_FORCED_UNPAIRED"),
        (crossing_structures(refolded, keys), "CROSSING_OUTPUT"),
    ]
    out = None
    for rows, name in parts:
        part = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("finding", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
