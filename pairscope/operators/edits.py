"""Edits made under evidence: hard conditions, scopes, edit accounting, compliance and comparisons.

Candidate tables carry manifest_id with rna_id, source, i, j. Evidence is reduced to endpoint flags before it meets
the candidates, so flags cost one equi-join on (manifest, position).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairscope.functions.ratios import exact_prf, ratio
from pairscope.operators.evidence import PAIR as PAIR_CHANNEL

# fixed values: published names of the item features, scaled ones before flags, and of the evidence descriptors
PAIR_ITEM_FEATURES = (
    "abs_i_a_norm", "abs_i_b_norm", "abs_j_a_norm", "abs_j_b_norm", "min_endpoint_distance_norm", "max_endpoint_distance_norm",
    "candidate_span_norm", "evidence_span_norm", "signed_span_difference_norm", "midpoint_distance_norm",
    "exact_same_pair", "shared_endpoint", "direct_conflict",
    "relation_CONTAINING", "relation_NESTED", "relation_CROSSING", "relation_DISJOINT",
)
UNPAIRED_ITEM_FEATURES = (
    "abs_i_k_norm", "abs_j_k_norm", "min_endpoint_distance_norm", "max_endpoint_distance_norm", "midpoint_distance_norm",
    "k_equals_i", "k_equals_j", "k_strictly_inside_pair_interval",
)
DESCRIPTORS = ("item_count", "item_count_div_sequence_length", "e1_local_conflict", "direct_pair_support")
SCALED = {"positive_pair": 10, "unpaired": 5}

PAIR = ["i", "j"]
CONTEXT = ["manifest_id", "rna_id", "source"]


def candidates_per_manifest(pairs: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    """Every pair of an RNA under each of its manifests."""
    return pairs.join(manifest_rows.select("rna_id", "manifest_id", "channel", "density", "seed"), "rna_id")


def with_scope(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Add ``exact``, ``local`` and the scope DIRECT, LOCAL_CONFLICT or NON_EVIDENCED, in that precedence."""
    pairs = items.where(F.col("channel") == PAIR_CHANNEL).select("manifest_id", *PAIR, F.lit(1).alias("_x"))
    touched = items.select("manifest_id", F.explode(F.array_compact(F.array("i", "j"))).alias("p")).distinct()
    left = touched.select("manifest_id", F.col("p").alias("i"), F.lit(1).alias("_ti"))
    right = touched.select("manifest_id", F.col("p").alias("j"), F.lit(1).alias("_tj"))
    rows = (
        candidates.join(pairs, ["manifest_id", *PAIR], "left").join(left, ["manifest_id", "i"], "left")
        .join(right, ["manifest_id", "j"], "left")
    )
    exact = F.col("_x").isNotNull()
    local = ~exact & (F.col("_ti").isNotNull() | F.col("_tj").isNotNull())
    return rows.withColumns({
        "exact": exact.cast("int"), "local": local.cast("int"),
        "scope": F.when(exact, "DIRECT").when(local, "LOCAL_CONFLICT").otherwise("NON_EVIDENCED")}).drop("_x", "_ti", "_tj")


def hard_conditions(scoped: DataFrame, items: DataFrame, manifest_rows: DataFrame, records: DataFrame) -> DataFrame:
    """(condition, context, i, j) of PAIR_PROTECT_ONLY, PAIR_HARD_ENFORCE and UNPAIRED_HARD_DELETE."""
    pair_side = F.col("channel") == PAIR_CHANNEL
    kept = scoped.where("local = 0").withColumn("condition", F.explode(F.when(
        pair_side, F.array(F.lit("PAIR_PROTECT_ONLY"), F.lit("PAIR_HARD_ENFORCE"))).otherwise(F.array(F.lit("UNPAIRED_HARD_DELETE")))))
    added = items.where(pair_side).join(records.select("rna_id", "source"), "rna_id").withColumn("condition", F.lit("PAIR_HARD_ENFORCE"))
    columns = ["condition", *CONTEXT, *PAIR]
    return kept.select(*columns).unionByName(added.select(*columns)).distinct()


def edit_flags(original: DataFrame, truth: DataFrame, result: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per pair in any of the three sets with membership flags o, t, r."""
    keys = list(keys)
    out = None
    for name, rows in (("o", original), ("t", truth), ("r", result)):
        part = rows.select(*keys, *PAIR, *[F.lit(int(name == n)).alias(n) for n in ("o", "t", "r")])
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*keys, *PAIR).agg(*[F.max(n).alias(n) for n in ("o", "t", "r")])


def _flag(text: str) -> Column:
    o, t, r = F.col("o") == 1, F.col("t") == 1, F.col("r") == 1
    return {
        "preserved_tp": o & t & r, "lost_tp": o & t & ~r, "removed_fp": o & ~t & ~r, "preserved_fp": o & ~t & r,
        "new_tp": ~o & t & r, "new_fp": ~o & ~t & r, "unchanged": o & r, "deleted": o & ~r, "added": ~o & r,
        "fn_before": ~o & t, "fn_after": t & ~r,
    }[text]


PARTS = ("preserved_tp", "lost_tp", "removed_fp", "preserved_fp", "new_tp", "new_fp", "unchanged", "deleted", "added",
         "fn_before", "fn_after")


def edit_decomposition(flags: DataFrame, keys: Sequence[str], contexts: DataFrame | None = None) -> DataFrame:
    """Edit parts per key; with ``contexts`` (the key columns) a context without any pair counts zero everywhere."""
    counted = flags.groupBy(*keys).agg(*[F.count_if(_flag(p)).alias(p) for p in PARTS])
    if contexts is None:
        return counted
    return contexts.select(*keys).join(counted, list(keys), "left").fillna(0, list(PARTS))


def _judged(kept: dict[str, Column], dropped: dict[str, Column]) -> dict[str, Column]:
    """Edit parts from how many pairs of each kind a result has, and how many it lacks: ``both`` of candidate and truth, ``extra``, ``missed``, ``new``."""
    c = {"preserved_tp": kept["both"], "lost_tp": dropped["both"], "removed_fp": dropped["extra"], "preserved_fp": kept["extra"], "new_tp": kept["missed"],
         "new_fp": kept.get("new", F.lit(0))}
    c |= {"unchanged": c["preserved_tp"] + c["preserved_fp"], "deleted": c["lost_tp"] + c["removed_fp"], "added": c["new_tp"] + c["new_fp"],
          "fn_before": kept["missed"] + dropped["missed"], "fn_after": dropped["both"] + dropped["missed"]}
    return {p: c[p].cast("bigint") for p in PARTS}


def _hard(enforced: Column) -> dict[str, Column]:
    """``_judged`` for a hard condition, from the counts of ``packed.counted``; the evidence is part of the truth."""
    n, local = ({k: F.col(f"{k}_{c}") for k in ("both", "extra", "missed")} for c in ("n", "local"))
    new = F.when(enforced, F.col("missed_direct")).otherwise(0)
    return _judged({"both": n["both"] - local["both"], "extra": n["extra"] - local["extra"], "missed": new},
                   {"both": local["both"], "extra": local["extra"], "missed": n["missed"] - new})


def condition_parts(counted: DataFrame) -> DataFrame:
    """Edit parts per condition and context from the counts of ``packed.counted``."""
    plain, full = (F.struct(F.lit(name).alias("condition"), *[c.alias(p) for p, c in _hard(F.lit(name == "PAIR_HARD_ENFORCE")).items()]) for name in (
        "PAIR_PROTECT_ONLY", "PAIR_HARD_ENFORCE"))
    only = plain.withField("condition", F.lit("UNPAIRED_HARD_DELETE"))
    conditions = F.explode(F.when(F.col("channel") == PAIR_CHANNEL, F.array(plain, full)).otherwise(F.array(only))).alias("c")
    return counted.select("*", conditions).select(*counted.columns, "c.*")


def scope_cells(counted: DataFrame) -> DataFrame:
    """(condition, source, scope, o, t, r, n): how many pairs have these flags, from the counts of ``packed.counted``."""
    kinds = {"both": (1, 1), "extra": (1, 0), "missed": (0, 1)}
    counts = [f"{k}_{c}" for k in kinds for c in ("n", "direct", "local")]
    sums = counted.groupBy("channel", "source").agg(*[F.sum(c).alias(c) for c in counts])
    pair, cells = F.col("channel") == PAIR_CHANNEL, []
    for k, (o, t) in kinds.items():
        direct, local = F.col(f"{k}_direct"), F.col(f"{k}_local")
        for scope, n in (("DIRECT", direct), ("LOCAL_CONFLICT", local), ("NON_EVIDENCED", F.col(f"{k}_n") - direct - local)):
            stays = int(o == 1 and scope != "LOCAL_CONFLICT")
            cells.append(F.struct(F.lit(scope).alias("scope"), F.lit(o).alias("o"), F.lit(t).alias("t"), F.lit(stays).alias("stays"),
                                  F.lit(max(stays, int(scope == "DIRECT"))).alias("enforced"), n.alias("n")))
    rows = sums.select("channel", "source", F.explode(F.array(*cells)).alias("c")).select("channel", "source", "c.*").where("n > 0")
    conditions = F.explode(F.when(pair, F.array(
        F.struct(F.lit("PAIR_PROTECT_ONLY").alias("condition"), F.col("stays").alias("r")), F.struct(F.lit("PAIR_HARD_ENFORCE").alias("condition"), F.col("enforced").alias("r"))
    )).otherwise(F.array(F.struct(F.lit("UNPAIRED_HARD_DELETE").alias("condition"), F.col("stays").alias("r"))))).alias("k")
    return rows.select("*", conditions).select("k.condition", "source", "scope", "o", "t", "k.r", "n")


def cell_decomposition(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``edit_decomposition`` of pairs that are counted by their flags."""
    return cells.groupBy(*keys).agg(*[F.sum(F.when(_flag(p), F.col("n")).otherwise(0)).alias(p) for p in PARTS])


def counted_methods(counted: DataFrame) -> DataFrame:
    """``method_parts`` from the counts of ``packed.counted`` and of a refolding's pairs: ``ref_both``, ``ref_extra``, ``ref_missed``, ``ref_new``."""
    zero = F.lit(0).cast("bigint")
    n = {k: F.col(f"{k}_n") for k in ("both", "extra", "missed")}
    ref = {k: F.col(f"ref_{k}") for k in ("both", "extra", "missed", "new")}
    methods = {
        ORIGINAL: _judged({"both": n["both"], "extra": n["extra"], "missed": zero}, {"both": zero, "extra": zero, "missed": n["missed"]}),
        "B1_LOCAL_HARD": _hard(F.col("channel") == PAIR_CHANNEL), "B2_GLOBAL_REFOLD": _judged(ref, {k: n[k] - ref[k] for k in n})}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), *[c.alias(p) for p, c in parts.items()]) for m, parts in methods.items()])).alias("m")
    return counted.select("*", each).select(*counted.columns, "m.*")


def edit_counts(parts: DataFrame) -> DataFrame:
    """Beneficial and harmful deletions and insertions from the decomposition."""
    return parts.withColumns({
        "beneficial_deletions": F.col("removed_fp"), "harmful_deletions": F.col("lost_tp"),
        "beneficial_insertions": F.col("new_tp"), "harmful_insertions": F.col("new_fp"),
        "beneficial_edits": F.col("removed_fp") + F.col("new_tp"), "harmful_edits": F.col("lost_tp") + F.col("new_fp"),
        "modified": F.col("deleted") + F.col("added")})


def before_after(parts: DataFrame) -> DataFrame:
    """F1 before and after, and preservation (1 when there was nothing to preserve)."""
    tp0, fp0, fn0 = F.col("preserved_tp") + F.col("lost_tp"), F.col("removed_fp") + F.col("preserved_fp"), F.col("fn_before")
    tp1, fp1, fn1 = F.col("preserved_tp") + F.col("new_tp"), F.col("preserved_fp") + F.col("new_fp"), F.col("fn_after")
    return parts.withColumns({
        "f1_before": exact_prf(tp0, fp0, fn0)[2], "f1_after": exact_prf(tp1, fp1, fn1)[2],
        "preservation": F.coalesce(ratio(F.col("preserved_tp"), tp0), F.lit(1.0))})


def evidence_compliance(items: DataFrame, original: DataFrame, result: DataFrame, keys: Sequence[str], channel: str) -> DataFrame:
    """Items satisfied before and after. A pair item must be present; an unpaired item must touch no pair."""
    keys = list(keys)
    if channel == PAIR_CHANNEL:
        on, side = [*keys, *PAIR], lambda rows: rows.select(*keys, *PAIR)
        good = lambda c: F.col(c).isNotNull()
    else:
        on, side = [*keys, "i"], lambda rows: rows.select(*keys, F.explode(F.array(*PAIR)).alias("i")).distinct()
        good = lambda c: F.col(c).isNull()
    rows = (
        items.join(side(original).withColumn("_b", F.lit(1)), on, "left").join(side(result).withColumn("_a", F.lit(1)), on, "left")
    )
    return rows.groupBy(*keys).agg(
        F.count("*").alias("items"), F.count_if(good("_b")).alias("before"), F.count_if(good("_a")).alias("after"),
        F.count_if(~good("_b") & good("_a")).alias("recovered"))


def pair_item_features(candidates: DataFrame, items: DataFrame, lengths: DataFrame) -> DataFrame:
    """The published features of every candidate against every evidence pair (a, b) of its manifest.

    The incidence table is the result itself; ``pooling`` gives means and maxima without it.
    """
    return pair_features(_incidence(candidates, items.select("manifest_id", F.col("i").alias("a"), F.col("j").alias("b")), lengths))


def pair_features(rows: DataFrame) -> DataFrame:
    """The published features of candidates (i, j) beside evidence pairs (a, b)."""
    i, j, a, b = [F.col(c) for c in ("i", "j", "a", "b")]
    relation = pair_relation(i, j, a, b)
    same, shared = (i == a) & (j == b), i.isin(a, b) | j.isin(a, b)
    gaps = {"abs_i_a_norm": F.abs(i - a), "abs_i_b_norm": F.abs(i - b), "abs_j_a_norm": F.abs(j - a), "abs_j_b_norm": F.abs(j - b)}
    scaled = gaps | {
        "candidate_span_norm": j - i, "evidence_span_norm": b - a, "signed_span_difference_norm": (b - a) - (j - i),
        "min_endpoint_distance_norm": F.least(*gaps.values()), "max_endpoint_distance_norm": F.greatest(*gaps.values()),
        "midpoint_distance_norm": F.abs((i + j) - (a + b)) / 2}
    flags = {"exact_same_pair": same, "shared_endpoint": shared, "direct_conflict": shared & ~same} | {
        name: relation == name.removeprefix("relation_") for name in PAIR_ITEM_FEATURES if name.startswith("relation_")}
    return rows.withColumns({n: scaled[n] / _scale() if n in scaled else flags[n].cast("int") for n in PAIR_ITEM_FEATURES})


def pair_relation(i: Column, j: Column, a: Column, b: Column) -> Column:
    """How the candidate lies to the evidence pair; equal pairs contain each other."""
    return (
        F.when((i <= a) & (b <= j), "CONTAINING").when((a <= i) & (j <= b), "NESTED")
        .when(((i < a) & (a < j) & (j < b)) | ((a < i) & (i < b) & (b < j)), "CROSSING").otherwise("DISJOINT"))


def unpaired_item_features(candidates: DataFrame, items: DataFrame, lengths: DataFrame) -> DataFrame:
    """The published features of every candidate against every unpaired position k of its manifest."""
    return unpaired_features(_incidence(candidates, items.select("manifest_id", F.col("i").alias("k")), lengths))


def unpaired_features(rows: DataFrame) -> DataFrame:
    """The published features of candidates (i, j) beside unpaired positions k."""
    i, j, k = F.col("i"), F.col("j"), F.col("k")
    near, far = F.abs(i - k), F.abs(j - k)
    scaled = {
        "abs_i_k_norm": near, "abs_j_k_norm": far, "min_endpoint_distance_norm": F.least(near, far),
        "max_endpoint_distance_norm": F.greatest(near, far), "midpoint_distance_norm": F.abs(i + j - 2 * k) / 2}
    flags = {"k_equals_i": k == i, "k_equals_j": k == j, "k_strictly_inside_pair_interval": (i < k) & (k < j)}
    return rows.withColumns({n: scaled[n] / _scale() if n in scaled else flags[n].cast("int") for n in UNPAIRED_ITEM_FEATURES})


def _scale() -> Column:
    return F.greatest(F.col("sequence_length") - 1, F.lit(1)).cast("double")


#: Rows of a manifest's incidence above which its candidates are dealt to one more task.
SALTED_ROWS = 1 << 20


def _incidence(candidates: DataFrame, items: DataFrame, lengths: DataFrame) -> DataFrame:
    """Candidates joined with the items of their manifest. Items are copied only where the manifest's incidence is large."""
    left = candidates.join(lengths.select("rna_id", "sequence_length"), "rna_id")
    counts = items.groupBy("manifest_id").agg(F.count("*").alias("m")).join(
        candidates.groupBy("manifest_id").agg(F.count("*").alias("n")), "manifest_id")
    large = counts.withColumn("salts", F.ceil(F.col("m") * F.col("n") / SALTED_ROWS).cast("int")).where("salts > 1").select("manifest_id", "salts")
    salts = F.coalesce("salts", F.lit(1))
    left = left.join(large, "manifest_id", "left").withColumn("salt", F.pmod(F.xxhash64("source", *PAIR), salts).cast("int")).drop("salts")
    right = items.join(large, "manifest_id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left.join(right, ["manifest_id", "salt"])


def conflict_correction(scoped: DataFrame, result: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: original pairs in local conflict with the evidence, and how many of them the result no longer has."""
    on = ["manifest_id", "source", *PAIR]
    rows = scoped.where("scope = 'LOCAL_CONFLICT'").join(result.select(*on, F.lit(1).alias("_r")).distinct(), on, "left")
    return rows.groupBy(*keys).agg(F.count("*").alias("conflicts_before"), F.count_if(F.col("_r").isNull()).alias("conflicts_removed"))


def summarize_conditions(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Micro and macro F1 before and after, with edit totals."""
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("f1_before").alias("macro_before"), F.avg("f1_after").alias("macro_after"),
        *[F.sum(p).alias(p) for p in PARTS])
    both = before_after(sums)
    return both.withColumns({
        "macro_delta": F.col("macro_after") - F.col("macro_before"), "micro_delta": F.col("f1_after") - F.col("f1_before"),
        "modification_precision": ratio(F.col("removed_fp") + F.col("new_tp"), F.col("deleted") + F.col("added"))})


#: Ratios of the method comparison, pooled and as means over RNAs.
METHOD_RATIOS = ("precision", "recall", "f1", "tp_preservation", "fp_removal", "modification_precision", "fp_removed_per_evidence_item")
ORIGINAL = "B0_ORIGINAL"


def method_parts(original: DataFrame, truth: DataFrame, results: dict[str, DataFrame], contexts: DataFrame) -> DataFrame:
    """Edit parts per (method, context). Pairs are counted once with a flag per method; the first method is the original itself.

    All tables carry the context columns; ``contexts`` also what else the comparison needs.
    """
    names = list(results)
    columns = ["o", "t", *names]
    rows = None
    for name, part in (("o", original), ("t", truth), *results.items()):
        part = part.select(*CONTEXT, *PAIR, *[F.lit(int(name == c)).alias(c) for c in columns])
        rows = part if rows is None else rows.unionByName(part)
    flags = rows.groupBy(*CONTEXT, *PAIR).agg(*[F.max(c).alias(c) for c in columns])
    methods = F.explode(F.array(F.struct(F.lit(ORIGINAL).alias("method"), F.col("o").alias("r")), *[
        F.struct(F.lit(n).alias("method"), F.col(n).alias("r")) for n in names])).alias("m")
    every = F.explode(F.array(*[F.lit(n) for n in (ORIGINAL, *names)])).alias("method")
    counted = edit_decomposition(flags.select(*CONTEXT, *PAIR, "o", "t", methods).select(*CONTEXT, *PAIR, "o", "t", "m.*"), ["method", *CONTEXT])
    return contexts.select("*", every).join(counted, ["method", *CONTEXT], "left").fillna(0, list(PARTS))


def _ratios(sums: DataFrame) -> DataFrame:
    """Ratios of summed parts and evidence items, and F1 before."""
    c = {p: F.col(p) for p in PARTS}
    tp, fp = c["preserved_tp"] + c["new_tp"], c["preserved_fp"] + c["new_fp"]
    precision, recall, f1 = exact_prf(tp, fp, c["fn_after"])
    before = exact_prf(c["preserved_tp"] + c["lost_tp"], c["preserved_fp"] + c["removed_fp"], c["fn_before"])[2]
    good, bad = c["removed_fp"] + c["new_tp"], c["lost_tp"] + c["new_fp"]
    return sums.withColumns({
        "precision": precision, "recall": recall, "f1": f1, "f1_before": before,
        "tp_preservation": ratio(c["preserved_tp"], c["preserved_tp"] + c["lost_tp"]),
        "fp_removal": ratio(c["removed_fp"], c["preserved_fp"] + c["removed_fp"]),
        "modification_precision": ratio(good, good + bad), "fp_removed_per_evidence_item": ratio(c["removed_fp"], F.col("items"))})


def compare_methods(parts: DataFrame, keys: Sequence[str], local: str) -> DataFrame:
    """Per key and method: sums, ratios pooled and as means over RNAs, and F1 gains over the original and the ``local`` method.

    Gains per evidence item are pooled, and as the mean over RNAs with items. Every method has the same contexts, so the
    original's F1 comes from the same sums. ``parts`` are read once: sums over RNAs are sums of an RNA's sums.
    """
    on, summed = [*keys, "method"], ["items", *PARTS]
    per_rna = _ratios(parts.groupBy(*on, "rna_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in summed]))
    gain = ratio(F.col("f1") - F.col("f1_before"), F.col("items"))
    sums = per_rna.withColumn("_gain", gain).groupBy(*on).agg(
        *[F.sum(c).alias(c) for c in ("n", *summed)],
        F.count("*").alias("rnas"), *[F.avg(m).alias(f"macro_{m}") for m in METHOD_RATIOS], *[F.count(m).alias(f"macro_{m}_defined") for m in METHOD_RATIOS],
        F.avg("f1_before").alias("macro_f1_before"), F.avg("_gain").alias("macro_delta_f1_per_evidence_item"),
        F.count("_gain").alias("macro_delta_f1_per_evidence_item_defined"))
    rows = _ratios(sums).withColumnsRenamed({m: f"micro_{m}" for m in METHOD_RATIOS})
    beside = Window.partitionBy(*keys)  # one row per method
    of_local = lambda c: F.max(F.when(F.col("method") == local, F.col(c))).over(beside)
    micro_gain = F.col("micro_f1") - F.col("f1_before")
    return rows.withColumns({
        "micro_delta_f1_vs_b0": micro_gain, "macro_delta_f1_vs_b0": F.col("macro_f1") - F.col("macro_f1_before"),
        "micro_delta_f1_vs_b1": F.col("micro_f1") - of_local("micro_f1"), "macro_delta_f1_vs_b1": F.col("macro_f1") - of_local("macro_f1"),
        "micro_delta_f1_per_evidence_item": ratio(micro_gain, F.col("items"))})


def seed_summary(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, population std, min, max and defined count over seeds; nulls are left out."""
    stats = []
    for m in metrics:
        stats += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"),
                  F.max(m).alias(f"{m}_max"), F.count(m).alias(f"{m}_n")]
    return rows.groupBy(*keys).agg(*stats)


def zero_evidence_identity(results: DataFrame, manifest_rows: DataFrame, records: DataFrame) -> DataFrame:
    """(rna, source) whose zero-density realizations do not all give one identical result; expected empty.

    Each realization is reduced to an order-free count and checksum before realizations are compared.
    """
    zero = manifest_rows.where("density = 0").select("rna_id", "manifest_id").join(records.select("rna_id", "source"), "rna_id")
    marks = results.groupBy(*CONTEXT).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*PAIR).cast("decimal(38,0)")).alias("mark"))
    rows = zero.join(marks, CONTEXT, "left")
    return rows.groupBy("rna_id", "source").agg(
        F.count_distinct(F.concat_ws(":", F.coalesce("n", F.lit(0)), F.coalesce("mark", F.lit(0)))).alias("distinct_results")
    ).where("distinct_results > 1")


def matched_views(baseline: DataFrame, treatment: DataFrame, eligible: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both sides limited to eligible manifests, as one table with a ``view`` column."""
    ok = eligible.where("eligibility = 'ELIGIBLE'").select("manifest_id")
    return baseline.withColumn("view", F.lit("baseline")).unionByName(treatment.withColumn("view", F.lit("treatment"))).join(ok, "manifest_id", "left_semi")
