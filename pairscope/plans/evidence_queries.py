"""Queries on evidence and edits. Evidence grids are operator parameters; every RNA takes part."""

from functools import cached_property

from pyspark.sql import functions as F

from pairscope.functions.ratios import ratio
from pairscope.functions.shaping import computed_once
from pairscope.operators import edits, evidence, noise, packed, pooling
from pairscope.operators.metrics import RECORD
from pairscope.plans.catalog import query
from pairscope.session import cut_lineage
from pairscope.sources.derived import DENSITIES, EVIDENCE_SEEDS, SOURCES

NOISE = (5, 10, 20, 30)


class Setup:
    """Universe, manifests and sampled items for one grid, and candidates with scopes.

    RNAs of ordinary size are packed, one row each; the few that are too large for that go through joins (``spread``).
    """

    def __init__(self, t, grid=(DENSITIES, EVIDENCE_SEEDS)):
        self.t, self.grid = t, grid
        self.universe = evidence.evidence_universe(t.truth, t.rnas)

    @cached_property
    def wide(self):
        return packed.wide_rnas(self.t.rnas, self.t.truth, self.t.predicted)

    def narrow(self, rows):
        return rows if self.wide is None else rows.join(self.wide, "rna_id", "left_anti")

    @cached_property
    def packed(self):
        return packed.universes(self.narrow(self.t.truth), self.narrow(self.t.rnas))

    def drawn(self, rows=None, channels=(evidence.PAIR, evidence.UNPAIRED)):
        """Manifest rows of the packed RNAs with their items."""
        return packed.sampled(packed.manifests(self.packed if rows is None else rows, *self.grid, channels))

    @cached_property
    def spread(self):
        """(manifests, items) of the RNAs that are not packed; None where all are."""
        if self.wide is None:
            return None
        universe, rnas = (rows.join(self.wide, "rna_id", "left_semi") for rows in (self.universe, self.t.rnas))
        rows = evidence.manifests(universe, rnas, *self.grid)
        return rows, cut_lineage(evidence.sample_evidence(universe, rows))

    def plus_spread(self, rows, other):
        """``rows`` and, where there are RNAs that are not packed, what ``other`` makes of their manifests and items."""
        return rows if self.spread is None else rows.unionByName(other(*self.spread).select(*rows.columns))

    @cached_property
    def manifests(self):
        return self.plus_spread(packed.manifests(self.packed, *self.grid).select(*packed.ROWS), lambda rows, items: rows)

    @cached_property
    def drawn_items(self):
        """Sampled items, for a query that reads them once."""
        return self.plus_spread(packed.item_rows(self.drawn()), lambda rows, items: items)

    @cached_property
    def items(self):
        """Sampled once, whatever reads it, and only if something does."""
        return cut_lineage(self.drawn_items)

    def candidates(self, pairs=None, channels=(evidence.PAIR, evidence.UNPAIRED)):
        """Manifest rows of the packed RNAs with their items and their candidates, the predicted pairs or ``pairs``."""
        return self.drawn(packed.with_candidates(self.packed, self.narrow(self.t.predicted if pairs is None else pairs)), channels)

    def with_scope(self, pairs=None):
        """Every candidate under each manifest with its scope, and the manifest's item count."""
        pairs = self.t.predicted if pairs is None else pairs

        def spread(rows, items):
            return edits.with_scope(edits.candidates_per_manifest(pairs, rows), items).join(rows.select("manifest_id", "selected"), "manifest_id")

        return self.plus_spread(packed.scoped(self.candidates(pairs), ["selected"]), spread)

    @cached_property
    def scoped(self):
        return self.with_scope().drop("selected")

    @cached_property
    def eligible(self):
        """Manifests with their eligibility."""
        rows = packed.eligibility(self.drawn(packed.with_tangled(self.packed))).select(*packed.ROWS, "min_separation", "loop_flag", "crossing_flag")
        return self.plus_spread(evidence.with_eligibility(rows), lambda rows, items: evidence.manifest_eligibility(items, rows))

    def with_sides(self, rows=None):
        """Packed RNAs with their pairs by source."""
        return packed.with_sides(self.packed if rows is None else rows, self.narrow(self.t.predicted), self.t.records)

    def sides(self, keep=(), channels=(evidence.PAIR, evidence.UNPAIRED)):
        """One row per manifest and source of the packed RNAs, with the source's pairs beside the evidence."""
        return packed.by_source(self.drawn(self.with_sides(), channels), keep)

    def eligible_sides(self, refolding=None, keep=()):
        """``sides`` with the manifest's eligibility; ``refolding`` names the source whose pairs are counted beside those of all."""
        rows = self.with_sides(packed.with_tangled(self.packed))
        rows = rows if refolding is None else packed.with_refolding(rows, refolding)
        return packed.by_source(evidence.with_eligibility(packed.eligibility(self.drawn(rows))), [*keep, "eligibility"])

    def spread_results(self, rows, items):
        """(condition, manifest, source, i, j) of the hard conditions for manifests and items of RNAs that are not packed."""
        scoped = edits.with_scope(edits.candidates_per_manifest(self.t.predicted, rows), items)
        return edits.hard_conditions(scoped, items, rows, self.t.records)

    def condition(self, name, channel):
        """The pairs of one hard condition's result."""
        made = packed.kept(self.sides(channels=(channel,)), enforced=name == "PAIR_HARD_ENFORCE")
        return self.plus_spread(made, lambda rows, items: self.spread_results(rows, items).where(F.col("condition") == name))

    @staticmethod
    def conditions(rows):
        """(manifest, rna, condition)."""
        condition = F.explode(F.when(F.col("channel") == evidence.PAIR, F.array(
            F.lit("PAIR_PROTECT_ONLY"), F.lit("PAIR_HARD_ENFORCE"))).otherwise(F.array(F.lit("UNPAIRED_HARD_DELETE")))).alias("condition")
        return rows.select("manifest_id", "rna_id", condition)

    def spread_flags(self, rows, items):
        """Membership flags of original, truth and result for each condition and context, and every (condition, context), pairs or not."""
        conditions = self.conditions(rows)
        contexts = conditions.join(self.t.records.select(*RECORD), "rna_id")
        return edits.edit_flags(
            conditions.join(self.t.predicted, "rna_id"), contexts.join(self.t.truth, "rna_id"), self.spread_results(rows, items), ["condition", *edits.CONTEXT]), contexts

    @cached_property
    def parts(self):
        """Edit parts per condition and manifest and source; ``known``: is the source a record of the RNA?"""
        def spread(rows, items):
            flags, contexts = self.spread_flags(rows, items)
            keys = ["condition", *edits.CONTEXT]
            every = contexts.withColumn("known", F.lit(True)).join(edits.edit_decomposition(flags, keys), keys, "full_outer").fillna(0, list(edits.PARTS))
            return every.withColumn("known", F.coalesce("known", F.lit(False))).join(rows.select("manifest_id", "channel", "density", "seed"), "manifest_id")

        counted = edits.condition_parts(packed.counted(self.sides()))
        return self.plus_spread(counted.select("condition", *edits.CONTEXT, "channel", "density", "seed", "known", *edits.PARTS), spread)

    @cached_property
    def cells(self):
        """How many pairs of a condition, source and scope are in original, truth and result, or not."""
        def spread(rows, items):
            flags = self.spread_flags(rows, items)[0].join(rows.select("manifest_id", "channel"), "manifest_id")
            return edits.with_scope(flags, items).groupBy("condition", "source", "scope", "o", "t", "r").agg(F.count("*").alias("n"))

        return self.plus_spread(edits.scope_cells(packed.counted(self.sides())), spread)


@query("x4_evidence_universe", "rna_id:s channel:s i:i j:i")
def _(t):
    return Setup(t).universe


@query("x5_sample_evidence", "manifest_id:s i:i j:i")
def _(t):
    return Setup(t).drawn_items


@query("x5_item_index", "manifest_id:s item_index:i i:i")
def _(t):
    s = Setup(t)
    return s.plus_spread(packed.item_rows(s.drawn(), indexed=True), lambda rows, items: evidence.with_item_index(items))


def noisy(s, levels, channels=(evidence.PAIR, evidence.UNPAIRED)):
    """Manifest rows of the packed RNAs with their delivered items at each noise level."""
    return noise.corrupted(s.drawn(noise.packed_for_noise(s.packed, s.t.rnas), channels), levels)


def spread_noisy(s, items, levels, channels=(evidence.PAIR, evidence.UNPAIRED)):
    """Delivered items of RNAs that are not packed."""
    out = evidence.corrupt_pairs(items, s.t.truth, s.t.rnas, levels) if evidence.PAIR in channels else None
    for level in levels if evidence.UNPAIRED in channels else ():
        part = evidence.corrupt_unpaired(items, s.t.truth, level).withColumn("noise", F.lit(level))
        out = part if out is None else out.unionByName(part)
    return out


def corrupted(t, channel):
    s = Setup(t)
    return s.plus_spread(noise.delivered_rows(noisy(s, NOISE, (channel,))), lambda rows, items: spread_noisy(s, items, NOISE, (channel,)))


@query("x6_corrupt_unpaired", "noise:i manifest_id:s clean_i:i i:i status:s")
def _(t):
    return corrupted(t, evidence.UNPAIRED)


@query("x6_corrupt_pair", "noise:i manifest_id:s clean_i:i clean_j:i i:i j:i status:s")
def _(t):
    return corrupted(t, evidence.PAIR)


def validated(t, levels, channels=(evidence.PAIR, evidence.UNPAIRED)):
    """Findings on corrupted evidence where every third manifest has modified clean items, and every fifth a wrong count."""
    s, d = Setup(t), F.col("rna_id").cast("bigint")
    miscounted = F.col("selected") + F.when(d % 5 == 0, 1).otherwise(0)

    def spread(rows, items):
        items = cut_lineage(spread_noisy(s, items, levels, channels))
        broken = items.withColumn("i", F.when((d % 3 == 0) & (F.col("status") == "CLEAN"), F.col("i") + 1000).otherwise(F.col("i")))
        rows = rows.where(F.col("channel").isin(*channels)).withColumn("selected", miscounted).withColumn("noise", F.explode(F.array(*[F.lit(n) for n in levels])))
        return evidence.validate_evidence(broken, rows, s.universe, t.truth, ["noise", "manifest_id"])

    broken = F.when(d % 3 == 0, F.transform("delivered", lambda x: x.withField(
        "i", F.when(x["status"] == "CLEAN", x["i"] + 1000).otherwise(x["i"])))).otherwise(F.col("delivered"))
    rows = noisy(s, levels, channels)
    rows = computed_once(rows.withColumn("selected", miscounted), "_broken", broken).drop("delivered").withColumnRenamed("_broken", "delivered")
    return s.plus_spread(noise.findings(rows), spread)


@query("x7_validate_evidence", "manifest_id:s finding:s")
def _(t):
    return validated(t, (20,), (evidence.UNPAIRED,))


@query("x7_validate_corruption", "noise:i manifest_id:s finding:s")
def _(t):
    # both channels at every noise level, with the faults of x7_validate_evidence
    return validated(t, NOISE)


@query("x8_payload_hash", "manifest_id:s payload_sha256:s")
def _(t):
    s = Setup(t)
    return s.plus_spread(evidence.payload_digest(packed.payloads(s.drawn())), lambda rows, items: evidence.payload_hash(rows, items))


@query("x9_evidence_index", "channel:s density:i seed:i rnas:i items:i mean_items:d min_items:i max_items:i minimum_one:i zero_items:i zero_universe:i")
def _(t):
    return evidence.evidence_counts(Setup(t).manifests)


@query("x10_pair_protect", "manifest_id:s source:s i:i j:i")
def _(t):
    return Setup(t).condition("PAIR_PROTECT_ONLY", evidence.PAIR)


@query("x11_pair_enforce", "manifest_id:s source:s i:i j:i")
def _(t):
    return Setup(t).condition("PAIR_HARD_ENFORCE", evidence.PAIR)


@query("x12_unpaired_delete", "manifest_id:s source:s i:i j:i")
def _(t):
    return Setup(t).condition("UNPAIRED_HARD_DELETE", evidence.UNPAIRED)


@query("x13_crossing_pairs", "rna_id:s source:s i:i j:i k:i l:i")
def _(t):
    return evidence.crossing_pairs(t.predicted, RECORD)


@query("x14_minimum_loop", "rna_id:s source:s i:i j:i")
def _(t):
    # no derived pair is that short; the inner neighbours of the predicted pairs reach the limit
    inner = t.predicted.select(*RECORD, (F.col("i") + 3).alias("i"), (F.col("j") - 3).alias("j")).where("i < j")
    return evidence.minimum_loop(inner)


@query("x15_manifest_eligibility", "manifest_id:s eligibility:s crossing_flag:i loop_flag:i min_separation:i")
def _(t):
    return Setup(t).eligible


@query("x16_eligibility_coverage", "level:s value:s manifests:i eligible:i rnas:i eligible_rnas:i zero_coverage_rnas:i")
def _(t):
    return evidence.eligibility_coverage(Setup(t).eligible)


@query("x17_constraint_conflicts", "rna_id:s source:s text:s code:s")
def _(t):
    # force each prediction's pairs, and leave position 9 of every fourth RNA unpaired
    free = t.records.where(F.col("rna_id").cast("bigint") % 4 == 0).select(*RECORD, F.lit(9).alias("position"))
    texts, faults = evidence.constraint_conflicts(t.predicted, free, t.records.select(*RECORD, "sequence_length"), RECORD)
    return texts.unionByName(faults, allowMissingColumns=True)


@query("x18_constraint_satisfaction", "rna_id:s n:i finding:s")
def _(t):
    refolded = t.predicted.where(F.col("source") == SOURCES[1]).select("rna_id", "i", "j")
    free = t.rnas.select("rna_id", F.lit(9).alias("position"))
    return evidence.constraint_satisfaction(refolded, t.rnas, t.truth, free, ["rna_id"])


@query("x19_local_conflict_risk", "manifest_id:s source:s i:i j:i local:i")
def _(t):
    return Setup(t).scoped


@query("x20_disagreement_risk", "rna_id:s source:s i:i j:i risk:i")
def _(t):
    other = t.predicted.where(F.col("source") == SOURCES[1]).select("rna_id", "i", "j", F.lit(1).alias("_in"))
    return t.predicted.join(other, ["rna_id", "i", "j"], "left").withColumn("risk", F.col("_in").isNull().cast("int"))


@query("x21_evidence_scope", "channel:s density:i seed:i source:s scope:s n:i")
def _(t):
    return Setup(t).scoped.groupBy("channel", "density", "seed", "source", "scope").agg(F.count("*").alias("n"))


@query("x22_scope_partition", "condition:s source:s scope:s n:i in_truth:i in_original:i in_result:i")
def _(t):
    n = F.col("n")
    return Setup(t).cells.groupBy("condition", "source", "scope").agg(
        F.sum("n").alias("n"), F.sum(n * F.col("t")).alias("in_truth"), F.sum(n * F.col("o")).alias("in_original"), F.sum(n * F.col("r")).alias("in_result"))


def incidence(t, channel):
    """The item features of each candidate with every item of its manifest."""
    s = Setup(t)
    pair = channel == evidence.PAIR
    met = packed.incidence(s.candidates(channels=(channel,)), {"i": "a", "j": "b"} if pair else {"i": "k"})
    rows = (edits.pair_features if pair else edits.unpaired_features)(met)

    def spread(manifests, items):
        of = edits.pair_item_features if pair else edits.unpaired_item_features
        return of(edits.candidates_per_manifest(t.predicted, manifests.where(F.col("channel") == channel)), items.where(F.col("channel") == channel), t.rnas)

    return s.plus_spread(rows, spread)


def pooled(t, channel):
    """Pooled item features of each candidate under each manifest of a channel."""
    s = Setup(t)
    one, spread = (pooling.pair_packed, pooling.pair_pooled) if channel == evidence.PAIR else (pooling.unpaired_packed, pooling.unpaired_pooled)

    def other(manifests, items):
        of = F.col("channel") == channel
        return spread(edits.candidates_per_manifest(t.predicted, manifests.where(of)), items.where(of), t.rnas)

    return s.plus_spread(one(s.candidates(channels=(channel,))), other)


def columns_of(channel, names):
    """Contract text: scaled features as numbers, flags as whole ones."""
    return " ".join(f"{n}:{'d' if k < edits.SCALED[channel] else 'i'}" for k, n in enumerate(names))


@query("x23_pair_item_features", "manifest_id:s source:s i:i j:i a:i b:i " + columns_of(evidence.PAIR, edits.PAIR_ITEM_FEATURES))
def _(t):
    return incidence(t, evidence.PAIR)


@query("x23_unpaired_item_features", "manifest_id:s source:s i:i j:i k:i " + columns_of(evidence.UNPAIRED, edits.UNPAIRED_ITEM_FEATURES))
def _(t):
    return incidence(t, evidence.UNPAIRED)


def totals(t, channel, columns):
    """Sums of the incidence features by source and density over the whole grid of manifests."""
    return incidence(t, channel).groupBy("density", "source").agg(F.count("*").alias("n"), *[F.round(F.sum(c), 6).alias(c) for c in columns])


PAIR_TOTALS = ("min_endpoint_distance_norm", "signed_span_difference_norm")
PAIR_FLAGS = edits.PAIR_ITEM_FEATURES[edits.SCALED[evidence.PAIR]:]
UNPAIRED_FLAGS = edits.UNPAIRED_ITEM_FEATURES[edits.SCALED[evidence.UNPAIRED]:]


@query("x23_pair_item_totals", "density:i source:s n:i " + " ".join(f"{c}:m" for c in PAIR_TOTALS) + " " + " ".join(f"{c}:i" for c in PAIR_FLAGS))
def _(t):
    return totals(t, evidence.PAIR, [*PAIR_TOTALS, *PAIR_FLAGS])


@query("x23_unpaired_item_totals", "density:i source:s n:i min_endpoint_distance_norm:m " + " ".join(f"{c}:i" for c in UNPAIRED_FLAGS))
def _(t):
    return totals(t, evidence.UNPAIRED, ["min_endpoint_distance_norm", *UNPAIRED_FLAGS])


def pooled_columns(names):
    return " ".join(f"mean_{n}:d max_{n}:d" for n in names) + " item_count:i item_count_div_sequence_length:d e1_local_conflict:i direct_pair_support:i"


@query("l2_evidence_pooled_features", "manifest_id:s source:s i:i j:i " + pooled_columns(edits.UNPAIRED_ITEM_FEATURES))
def _(t):
    return pooled(t, evidence.UNPAIRED)


@query("l2_pair_pooled_features", "manifest_id:s source:s i:i j:i " + pooled_columns(edits.PAIR_ITEM_FEATURES))
def _(t):
    return pooled(t, evidence.PAIR)


PARTS = " ".join(f"{p}:i" for p in edits.PARTS)


@query("x24_edit_decomposition", "condition:s manifest_id:s source:s " + PARTS)
def _(t):
    return Setup(t).parts.where("known")


@query("x25_edit_counts",
       "condition:s source:s beneficial_deletions:i harmful_deletions:i beneficial_insertions:i harmful_insertions:i beneficial_edits:i "
       "harmful_edits:i modified:i")
def _(t):
    # a pair is in the original, or is not before
    rows = Setup(t).parts.where("unchanged + deleted + added + fn_before > 0")
    return edits.edit_counts(rows.groupBy("condition", "source").agg(*[F.sum(p).alias(p) for p in edits.PARTS]))


@query("x26_evidence_compliance",
       "channel:s source:s items:i before:i after:i compliance_before:d compliance_after:d recovered:i inserted:i already_unpaired:i "
       "conflicts_before:i conflicts_removed:i correction_rate:d")
def _(t):
    s = Setup(t)
    sums = ("items", "before", "after", "recovered", "conflicts_before", "conflicts_removed")

    def spread(rows, items):
        results, out = s.spread_results(rows, items), None
        for channel, name in ((evidence.PAIR, "PAIR_HARD_ENFORCE"), (evidence.UNPAIRED, "UNPAIRED_HARD_DELETE")):
            of = F.col("channel") == channel
            candidates, result = edits.candidates_per_manifest(t.predicted, rows.where(of)), results.where(F.col("condition") == name)
            on_records = items.where(of).join(t.records.select(*RECORD), "rna_id")
            part = edits.evidence_compliance(on_records, candidates, result, ["manifest_id", "source"], channel)
            part = part.groupBy("source").agg(*[F.sum(c).alias(c) for c in sums[:4]])
            part = part.join(edits.conflict_correction(edits.with_scope(candidates, items), result, ["source"]), "source", "full_outer").fillna(0, list(sums))
            part = part.withColumn("channel", F.lit(channel))
            out = part if out is None else out.unionByName(part)
        return out

    rows = s.plus_spread(packed.compliance(s.sides(["items"])).groupBy("channel", "source").agg(*[F.sum(c).alias(c) for c in sums]), spread)
    rows = rows.groupBy("channel", "source").agg(*[F.sum(c).alias(c) for c in sums]).where("items > 0")
    pairs = F.col("channel") == evidence.PAIR
    return rows.withColumns({
        "compliance_before": ratio(F.col("before"), F.col("items")), "compliance_after": ratio(F.col("after"), F.col("items")),
        # an unpaired position is never recovered or inserted; one that was free before counts as such
        "inserted": F.when(pairs, F.col("recovered")).otherwise(0), "already_unpaired": F.when(pairs, 0).otherwise(F.col("before")),
        "correction_rate": ratio(F.col("conflicts_removed"), F.col("conflicts_before"))}).withColumn("recovered", F.col("inserted"))


@query("x27_scope_metrics", "condition:s source:s scope:s f1_before:d f1_after:d preservation:d lost_tp:i removed_fp:i new_tp:i new_fp:i")
def _(t):
    return edits.before_after(edits.cell_decomposition(Setup(t).cells, ["condition", "source", "scope"]))


def per_context(s):
    return edits.before_after(s.parts.where("known"))


SUMMARY = "n:i macro_before:d macro_after:d macro_delta:d f1_before:d f1_after:d micro_delta:d preservation:d modification_precision:d"


@query("x28_gain_attribution", "density:i source:s full_delta:d local_delta:d insertion_delta:d")
def _(t):
    rows = edits.summarize_conditions(per_context(Setup(t)), ["condition", "density", "source"])
    # side by side from one pass over the evidence
    delta = lambda name: F.max(F.when(F.col("condition") == name, F.col("micro_delta")))
    wide = rows.groupBy("density", "source").agg(delta("PAIR_HARD_ENFORCE").alias("full_delta"), delta("PAIR_PROTECT_ONLY").alias("local_delta"))
    return wide.where("full_delta IS NOT NULL AND local_delta IS NOT NULL").withColumn("insertion_delta", F.col("full_delta") - F.col("local_delta"))


@query("x29_matched_views", "channel:s view:s contexts:i rows:i empty:i unmatched:i")
def _(t):
    s = Setup(t)

    def spread(rows, items):
        eligible = cut_lineage(evidence.manifest_eligibility(items, rows).where("eligibility = 'ELIGIBLE'").select("manifest_id", "rna_id", "channel"))
        baseline = edits.candidates_per_manifest(t.predicted, rows).select("manifest_id", "source", "i", "j")
        treatment = s.spread_results(rows, items).where("condition <> 'PAIR_PROTECT_ONLY'").select("manifest_id", "source", "i", "j")
        views = edits.matched_views(baseline, treatment, eligible.withColumn("eligibility", F.lit("ELIGIBLE")), ["manifest_id"])
        contexts = eligible.join(t.records.select(*RECORD), "rna_id").withColumn("view", F.explode(F.array(F.lit("baseline"), F.lit("treatment"))))
        return contexts.join(views.groupBy("view", "manifest_id", "source").agg(F.count("*").alias("n")), ["view", "manifest_id", "source"], "full_outer").withColumn(
            "known", F.col("rna_id").isNotNull())

    counted = packed.counted(s.eligible_sides()).where("eligibility = 'ELIGIBLE'")
    before = F.col("both_n") + F.col("extra_n")
    after = before - F.col("both_local") - F.col("extra_local") + F.when(F.col("channel") == evidence.PAIR, F.col("missed_direct")).otherwise(0)
    views = F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.nullif(n, F.lit(0)).alias("n")) for v, n in (("baseline", before), ("treatment", after))])).alias("v")
    rows = counted.select("channel", "known", views).select("channel", "known", "v.*").where("known OR n IS NOT NULL")
    rows = s.plus_spread(rows.withColumn("channel", F.when(F.col("known"), F.col("channel"))), spread)
    return rows.groupBy("channel", "view").agg(
        F.count("*").alias("contexts"), F.sum(F.coalesce("n", F.lit(0))).alias("rows"), F.count_if(F.col("n").isNull()).alias("empty"),
        F.count_if(~F.col("known")).alias("unmatched"))


METHOD_COLUMNS = (
    "channel:s density:i source:s method:s n:i rnas:i items:i " + " ".join(f"{p}:i" for p in edits.PARTS) + " "
    + " ".join(f"micro_{m}:d macro_{m}:d macro_{m}_defined:i" for m in edits.METHOD_RATIOS)
    + " micro_delta_f1_vs_b0:d macro_delta_f1_vs_b0:d micro_delta_f1_vs_b1:d macro_delta_f1_vs_b1:d micro_delta_f1_per_evidence_item:d "
    "macro_delta_f1_per_evidence_item:d macro_delta_f1_per_evidence_item_defined:i")


@query("x30_method_compare", METHOD_COLUMNS)
def _(t):
    # the original, the hard local conditions, and the second source's structure as a refolding, where evidence is eligible
    s = Setup(t)
    refolded = t.predicted.where(F.col("source") == SOURCES[1]).select("rna_id", *edits.PAIR)

    def spread(rows, items):
        eligible = cut_lineage(evidence.manifest_eligibility(items, rows).where("eligibility = 'ELIGIBLE'").select("manifest_id"))
        rows = rows.join(eligible, "manifest_id", "left_semi").select("manifest_id", "rna_id", "channel", "density", F.col("selected").alias("items"))
        contexts = rows.join(t.records.select(*RECORD), "rna_id")
        thin = contexts.select(*edits.CONTEXT)
        return edits.method_parts(
            thin.join(t.predicted, RECORD), thin.join(t.truth, "rna_id"),
            {"B1_LOCAL_HARD": s.spread_results(*s.spread).where("condition <> 'PAIR_PROTECT_ONLY'").join(eligible, "manifest_id", "left_semi"),
             "B2_GLOBAL_REFOLD": thin.join(refolded, "rna_id")}, contexts)

    counted = packed.counted(s.eligible_sides(SOURCES[1], ["selected"])).where("known AND eligibility = 'ELIGIBLE'")
    parts = edits.counted_methods(counted.withColumnRenamed("selected", "items"))
    names = [*edits.CONTEXT, "channel", "density", "items", "method", *edits.PARTS]
    return edits.compare_methods(s.plus_spread(parts.select(*names), spread), ["channel", "density", "source"], "B1_LOCAL_HARD")


@query("x31_seed_summary", "condition:s density:i macro_delta_mean:d macro_delta_std:d macro_delta_min:d macro_delta_max:d macro_delta_n:i")
def _(t):
    rows = edits.summarize_conditions(per_context(Setup(t)), ["condition", "density", "seed"])
    return edits.seed_summary(rows, ["condition", "density"], ["macro_delta"])


@query("x32_zero_evidence_identity", "rna_id:s source:s distinct_results:i")
def _(t):
    s = Setup(t, ((0,), EVIDENCE_SEEDS))
    results = packed.kept(s.sides(), enforced=True)
    results = s.plus_spread(results, lambda rows, items: s.spread_results(rows, items).drop("condition").distinct())
    return edits.zero_evidence_identity(results, s.manifests, t.records)
